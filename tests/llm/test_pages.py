"""Ops 3, 5 and 9."""

import base64
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from shotlens.llm import url_filter
from shotlens.llm.html_text import Block, extract_pages, function_words, inherit, judge, main_text
from shotlens.llm.url_filter import QUERY_RULES, Rule, judge_urls
from shotlens.llm.warc import BundleWriter, parse_record, read_archive, read_frame, read_seek_table, record_number, warc_record, write_archive
from shotlens.session import shared_dir


def test_bundle_is_seekable():
    out = io.BytesIO()
    w = BundleWriter(out, frame_bytes=1000)
    records = {f"r{i}": warc_record("response", f"r{i}", "http://x", "D", b"p" * (i * 97), i * 97) for i in range(30)}
    for k, r in records.items():
        w.add(k, r)
    index = w.close()
    table = read_seek_table(out, len(out.getvalue()))
    assert len(table) > 3
    for rid, frame, start, size, offset, length in index:
        assert table[frame][:2] == (start, size)
        data = read_frame(out, *table[frame])
        assert data[offset : offset + length] == records[rid]
        assert len(parse_record(records[rid])["payload"]) == int(rid[1:]) * 97


def test_archive_round_trip(spark, no_rows):
    rows = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 100_000), (5, "u", "é" * 100_000), (6, "u\r\nX: y", "z"), (None, "u", "<p>x")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    to = shared_dir(spark, "t")
    index = write_archive(spark, pages, to)
    got = read_archive(spark, index, to, payload=True).select(record_number("record_id").alias("i"), "payload_bytes", "payload_digest", "record_type", record_number("refers_to").alias("ref"), "payload").collect()
    best: dict = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw, ref = (h or "").encode(), best[h or ""] if i != best[h or ""] else None
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", str(ref), str(raw if ref is None else None)))
    assert sorted((str(r["i"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["ref"]), str(None if r["payload"] is None else bytes(r["payload"]))) for r in got) == sorted(want)
    short = write_archive(spark, pages, shared_dir(spark, "t"), min_revisit_bytes=1000)
    assert short.count() == len(rows)
    to = shared_dir(spark, "t")
    assert read_archive(spark, write_archive(spark, no_rows, to), to).count() == 0


def fits(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    found = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(found, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


URLS = [None, "", "x", "http://example.com", "http://EXAMPLE.com/en/1", "http://a.www.example.com/en/?q", "http://example.net/es/x#y", "http://net/fr/", "http://.net/es/", "http://x.net/esx", "http://x.com:80/en/", "://com/", "http://a://b.net/es/", "http://notexample.com/en/z", "http://É.com/\n/a", "http://x.org/" + "a/" * 3000]


@pytest.mark.parametrize("most", [100, 0])
def test_url_filter_against_a_scan(spark, monkeypatch, no_rows, most):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
    rules = [*QUERY_RULES, Rule("block", "b.net", "/es/x"), Rule("allow", "b.net", "/es/x"), Rule("block", "org", "/a/a/a")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://x.com/", "x"), (3, "http://example.com", "x")], "page_id long, url string, rule string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in judge_urls(spark, pages, rules).collect())
    want = sorted((str(r["page_id"]), h, p, str(t), v) for r in pages.collect() for h, p, t, v in [fits(r["url"], rules)])
    assert got == want
    assert judge_urls(spark, no_rows, rules).count() == 0


LONG = "This is a long paragraph of the text that is in the page, and it has many of the words that one would expect to see in it, so that the density of stop words is high and the length of it is over two hundred characters in all of it."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><p>Name of the site</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">{LONG}</div><div id=main-content><h2>The head &amp; more</h2><p>{LONG}</p><p>Short   one<br>of\nit.</p><p>{LONG}
<div class="adBox ad">{LONG}</div><p>{LONG}</div><aside><p>{LONG}</p></aside><section class="comments"><article><p>{LONG}</p></article></section><form><p>{LONG}</p></form><p><a href=x>{LONG}</a></p><footer>&copy; {LONG}</footer>"""


def test_main_text_by_rules():
    assert main_text(PAGE) == ["The head & more", LONG, "Short one of it.", LONG, LONG]
    assert main_text("") == [] and main_text("<p") == [] and main_text("plain") == []
    assert main_text("<nav>x<article><h1>A</h1><p>b&#233;<br></article>") == []
    assert main_text("<article><h1>A</h1><p>b&#233;&nbsp;c<br></article>") == ["A", "bé c"]


def test_short_block_next_to_a_nearly_good_one():
    near = "Here is a paragraph of some words that is in the middle of it all, and it has the stop words that one would expect to see in text."
    menu = '<div><a href="/a">Home</a> <a href="/b">News</a></div>'
    assert main_text(f"<body>{menu}<div>The first.</div><div>{near}</div><div>{near}</div><div>The last.</div>{menu}</body>") == ["The first.", near, near, "The last."]
    assert main_text(f"<body>{menu}<div>The first.</div><div>{LONG}</div><div>The last.</div>{menu}</body>") == [LONG]
    assert main_text(f"<body>{menu}<div>The first.</div>{menu}</body>") == []


def test_containers_are_a_feature():
    assert main_text(f'<div class="page with-sidebar"><p>{LONG}</p></div>') == [LONG]
    assert main_text('<div class="content-sidebar-wrap"><main><p>Short.</p></main><aside class="sidebar"><p>x</p></aside></div>') == ["Short."]
    assert main_text(f'<section class="comments"><article><p>{LONG}</p></article></section><div class="sidebar"><p>{LONG}</p></div>') == []
    russian = "Это длинный абзац. Он состоит из нескольких предложений, и ссылок в нём нет. " * 4
    menu = '<div><a href="/a">Меню</a></div>'
    assert main_text(f"<body>{menu}<div>{russian}</div><div>{russian}</div>{menu}") == [russian.strip()] * 2
    assert main_text(f"<body>{menu}<div>{'слово ' * 60}</div>{menu}") == []
    assert main_text(f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>Short.</p><p><a href=x>{LONG}</a></p></article>") == [LONG]


def two_passes(blocks, stop_words):
    """Labels by the rules, written down again without windows: for each block all others are looked at."""
    first = []
    for b in blocks:
        words = [w for w in re.findall(r"[^\W\d_]+", b.text.lower())]
        share = sum(w in stop_words for w in words) / (len(words) or 1)
        if b.bad or b.links > 0.25 * len(b.text):
            first.append("bad")
        elif b.heading or len(b.text) < 70:
            first.append("bad" if b.links and not b.main and not b.heading else "short")
        elif share >= 0.2:
            first.append("good" if b.main or len(b.text) > 200 else "near")
        else:
            first.append("near" if share >= 0.1 or b.main else "bad")

    def side(i, others, labels, skip):
        for j in others:
            if blocks[i].main and not (blocks[j].bad or blocks[j].main):
                return "good", False
            if labels[j] not in skip and not (blocks[i].main and blocks[j].bad):
                return labels[j], first[j] == "near"
        return ("good" if blocks[i].main else "bad"), False

    second = [
        f if f != "near" else "good" if len(blocks[i].text) > 100 or "good" in (side(i, range(i - 1, -1, -1), first, ("short", "near"))[0], side(i, range(i + 1, len(blocks)), first, ("short", "near"))[0]) else "bad"
        for i, f in enumerate(first)
    ]
    out = []
    for i, f in enumerate(second):
        if f == "short":
            (a, near_a), (b, near_b) = side(i, range(i - 1, -1, -1), second, ("short",)), side(i, range(i + 1, len(blocks)), second, ("short",))
            f = b if blocks[i].heading else a if a == b else "good" if blocks[i].main or near_a or near_b else "bad"
        out.append(f)
    return out


def test_two_passes_against_brute_force():
    rng = random.Random(2)
    stop, other = ["the", "of", "is", "it"], ["table", "river", "stone", "window"]
    for _ in range(300):
        blocks = []
        for _ in range(rng.randint(1, 14)):
            p = rng.choice((0, 0.15, 0.3))
            text = " ".join(rng.choice(stop if rng.random() < p else other) for _ in range(rng.choice((2, 16, 22, 60))))
            blocks.append(Block(text=text, links=rng.choice((0, 0, 3, len(text))), bad=rng.random() < 0.15, main=rng.random() < 0.4, heading=rng.random() < 0.1))
        for b in blocks:
            b.label = judge(b, frozenset(stop))
        inherit(blocks)
        assert [b.label for b in blocks] == two_passes(blocks, stop)


def test_function_words_are_learned(spark, no_rows):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("кстрнлв") + rng.choice("аеио") for _ in range(rng.randint(3, 5)))
    page = lambda n: f"<html lang='ru'><body><div>{' '.join(rng.choice(['не', 'и', 'на', 'что']) + ' ' + word() for _ in range(n))}</div><nav><a href=x>меню</a></nav></body></html>"
    pages = spark.createDataFrame([(i, None, page(20)) for i in range(60)] + [(90 + i, None, "<html lang='xx'><p>rare words") for i in range(9)], "page_id long, url string, html string")
    assert function_words(spark, pages) == {"не", "и", "на", "что"}
    assert function_words(spark, no_rows) == frozenset()
    got = extract_pages(spark, pages.where("page_id < 60")).agg(F.min("n_chars")).head()[0]
    assert got > 100


def test_extract_pages_cases(spark, no_rows):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<article><p>x</p></article>"), (5, "u", "<article>" + "<p>long words of it</p>" * 20_000 + "</article>"), (6, "u", "<" * 2000 + '"' * 2000)]
    got = extract_pages(spark, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(len(r["text"]) == r["n_chars"] for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[5] == 20_000 * len("long words of it\n") - 1
    assert extract_pages(spark, no_rows).agg(F.count("*")).head()[0] == 0
