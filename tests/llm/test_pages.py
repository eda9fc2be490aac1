"""URL filter, archives and embeddings against plain versions."""

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import pivot_index, url_filter, warc
from tidemark.llm.scratch import Scratch

URLS = [
    None, "", "no scheme.org/x", "http://", "HTTP://Example.ORG", "http://example.org/es/a?b", "http://a.example.org/en/12#x", "http://notexample.org/es/a", "https://WWW.Shop.com/fr/x",
    "https://shop.com/de", "https://shop.com/de/?q=/fr/", "ftp://a.net/com/fr/", "http://com/de/1", "x://y://z.org/a", "http://é.org/ü?x", "http://host.org?x=/a", "http://a.org:80/x", "http://u:p@a.net:81/", "http://10.0.0.1/x", "http://10.0.0.2:8080/x", "http://[::1]/x", "http://b.co.uk/",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain_rule(host, path):
    best = None
    for kind, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return best


def plain_blocked(rows, bad):
    """Hosts blocked by the posterior bound, by the formulas of the module's docstring."""
    def name_of(k, host):
        if re.fullmatch(url_filter.IP_ADDRESS, host):
            return (host, host, "")[k]
        labels = host.split(".")
        n = 2 if ".".join(labels[-2:]) in url_filter.LONG_SUFFIXES else 1
        return (host, ".".join(labels[-n - 1 :]), ".".join(labels[-n:]))[k]

    rows = [(page, re.sub(":[0-9]*$", "", re.sub("^.*@", "", host))) for page, host in rows]
    over = {1: {}, 0: {}}
    level = {2: collections.defaultdict(lambda: [0, 0]), 1: collections.defaultdict(lambda: [0, 0]), 0: collections.defaultdict(lambda: [0, 0])}
    for page, host in rows:
        over[0][host], over[1][name_of(1, host)] = name_of(1, host), name_of(2, host)
        for k, name in ((k, name_of(k, host)) for k in range(3)):
            level[k][name][0] += page in bad
            level[k][name][1] += bad.get(page, 0)
    total = [sum(v[i] for v in level[2].values()) for i in (0, 1)]
    above = collections.defaultdict(lambda: (total[1] + url_filter.START_BAD) / (total[0] + url_filter.START_PAGES))
    for k in (2, 1, 0):
        prior = {name: above[over[k][name] if k < 2 else name] for name in level[k]}
        seen = one = square = 0.0
        for name, (n, b) in level[k].items():
            p = min(max(prior[name], 1e-6), 1 - 1e-6)
            if n:
                seen, one, square = seen + (b - n * p) ** 2, one + n * p * (1 - p), square + n * n * p * (1 - p)
        m = 1000.0 if seen <= one else max(2.0, min(1000.0, (square - seen) / (seen - one)))
        post = {name: ((b + m * prior[name]) / (n + m), n + m) for name, (n, b) in level[k].items()}
        above = {name: v[0] for name, v in post.items()}
    return {h for h, (p, s) in post.items() if p - url_filter.Z * (p * (1 - p) / (s + 1)) ** 0.5 > url_filter.BAD_LIMIT}


def test_url_filter(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.d{i % 7}.{('net', 'xyz', 'co.uk')[i % 3]}{('', ':80')[i % 4 == 1]}" for i in range(30)]
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://h1.d1.xyz/none")] + [(100 + i, f"http://{rng.choice(hosts[: 1 + i % 30])}/p{i}") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS bad", "'x' AS n")
    outcomes = [(i or 0, int(rng.random() < (0.9 if u and ".xyz" in u else 0.1))) for i, u in rows if i and i % 3]
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    blocked = plain_blocked([(i, plain_parts(u)[0]) for i, u in rows], dict(outcomes))
    hosts_of = lambda u: re.sub(":[0-9]*$", "", re.sub("^.*@", "", plain_parts(u)[0]))
    assert blocked and len(got) == len(rows)
    for i, u in rows:
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1]), u
        assert got[i]["verdict"] == (rule[0] if rule else "block" if hosts_of(u) in blocked else "allow"), u
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_filter.filter_urls(pages, none).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_url_filter_on_labels(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    outcomes = url_filter.label_outcomes(spark.read.parquet(f"{small}/labels.parquet"))
    assert outcomes.count() == outcomes.select("page_id").distinct().count()
    assert url_filter.filter_urls(pages, outcomes).count() == pages.count()


HTML = [None, "", "<p>a</p>", "<p>a</p>", "Grüße\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "\r\n\r\n", "HTTP/1.1 200 OK\r\nX-Page-Id: 77\r\n\r\nno", "", "a\x00b"]


@pytest.mark.parametrize("source", ["cases", "pages"])
def test_archive_round_trip(spark, small, source):
    if source == "cases":
        pages = spark.createDataFrame([(i * 3 - 4, URLS[i], h) for i, h in enumerate(HTML)], "page_id long, url string, html string").selectExpr("*", "'q' AS digest", "1 AS key", "2 AS first")
    else:
        pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for i, body in sorted(rows):
        first.setdefault(body, i)
    want = {(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in rows}
    got = warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_empty_archive(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_foreign_arc_files(spark, tmp_path):
    """Hand-made files of both versions, one of gzip members, with records that are not HTTP and a 12-digit date."""
    (tmp_path / "arc").mkdir()
    one = warc.arc_version_block("1", "a.arc") + b"\ndns:example.org 1.2.3.4 20010203040506 text/dns 5\nhello\nhttp://x/ 1.2.3.4 200102030405 text/html 19\nHTTP/1.0 200 OK\n\nhi\n"
    two = warc.arc_version_block("2", "b.arc") + b"\nhttp://y/ 1.2.3.4 20010203040506 text/html 200 - - 0 b.arc 2\nhi\n"
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(one[:40]) + gzip.compress(one[40:]))
    (tmp_path / "arc" / "b.arc").write_bytes(two)
    scratch = Scratch(spark, "test")
    warc.convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc", scratch)
    got = {r["url"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    assert {u: r["payload_bytes"] for u, r in got.items()} == {"dns:example.org": 5, "http://x/": 2, "http://y/": 2}
    assert got["http://x/"]["date"] == "2001-02-03T04:05:00Z"
    assert sorted(r["record_type"] for r in got.values()) == ["response", "response", "revisit"]
    for bad in (b"http://y/ 1.2.3.4 20010203040506 text/html 99\nhi\n", b"junk\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(warc.arc_version_block("1", "c") + b"\n" + bad))


def test_only_the_version_block_is_skipped():
    data = warc.arc_version_block("1", "c") + b"\n" + warc.arc_record("1", "filedesc://page", b"hi", "c")
    assert [(f["URL"], block) for f, block in warc.parse_arc(data)] == [("filedesc://page", b"hi")]


def test_record_ids_hold_their_key():
    for key in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert warc.record_key(warc.record_id(key)) == key


def plain_links(rows, least=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    sim = unit @ unit.T >= least
    np.fill_diagonal(sim, False)
    return [i for i, _ in good], sim


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 32))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    for k in range(60):  # near copies, copies, scaled copies
        v = base[k % 20] + rng.normal(size=32) * (0.05, 0.0, 0.1)[k % 3]
        rows.append((1000 + k, [float(np.float32(x)) for x in v * (1.0, 1.0, 4.0)[k % 3]]))
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [1.0] * 31 + [None]), (2004, [float("nan")] * 32), (2005, [float("inf")] * 32), (2006, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS weight", "3 AS label", "4 AS component")
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(table).collect()}
    assert len(got) == len(rows)
    ids, sim = plain_links(rows)
    true, found = sim.sum(), sum(got[i]["n_links"] for i in ids)
    assert 0.9 * true <= found <= true
    for i in range(2000, 2007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    comp = {}
    for a, i in enumerate(ids):
        assert got[i]["n_links"] <= sim[a].sum() and got[i]["kept"] == (got[i]["component_id"] == i)
        comp.setdefault(got[i]["component_id"], []).append(a)
    for root, members in comp.items():
        assert root == min(ids[a] for a in members)
        assert len(members) == 1 or all(sim[a][[b for b in members if b != a]].any() for a in members)


@pytest.mark.parametrize("size", [1500, 10_000, 40_000])
def test_near_vectors_recall_by_band(spark, size):
    """The table's vectors (with random ones beyond it) are far apart; 900 have a copy at a cosine of each band."""
    rng = np.random.default_rng(11)
    base = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()])[:size]
    base = np.concatenate([base, rng.normal(size=(size - len(base), base.shape[1]))])
    base /= np.linalg.norm(base, axis=1)[:, None]
    bands, copies = [(0.9001, 0.91), (0.91, 0.93), (0.93, 0.999)], []
    for k in range(900):
        noise = rng.normal(size=base.shape[1])
        noise -= noise @ base[k] * base[k]
        cosine = rng.uniform(*bands[k % 3])
        copies.append(base[k] * cosine + noise / np.linalg.norm(noise) * np.sqrt(1 - cosine**2))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, copies]))]
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for b in range(3):
        found = [got[size + k]["n_links"] == 1 and got[size + k]["component_id"] == k for k in range(b, 900, 3)]
        assert sum(found) >= 0.9 * len(found), (bands[b], sum(found) / len(found))
    assert all(got[i]["n_links"] == 0 for i in range(900, size))


def test_equal_and_near_vectors_of_a_large_list(spark):
    """300 unequal near vectors, more than a block, all link with each other, and copies count."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=16)
    rows = [(k, (center + rng.normal(size=16) * 1e-3).tolist()) for k in range(300)] + [(300 + k, (rng.normal(size=16)).tolist()) for k in range(40)]
    rows += [(1000 + k, rows[k][1]) for k in range(5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), n_pivots=12).collect()}
    assert all(got[k] == (304, 0) for k in [*range(300), *range(1000, 1005)])


def test_near_vectors_of_an_empty_table(spark):
    assert pivot_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in pivot_index.near_vectors(none).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_near_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0])]
    got = sorted(tuple(r) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 1, 6, True), (6, 1, 6, True)]
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [0.01, 1.0])]
    got = {(r["vec_id"], r["embedding"][0]): r[1:4] for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id").collect()}
    assert got[(2, 1.0)] == (1, 2, True) and got[(4, 0.01)] == (0, 4, True)


def test_pages_without_ids_and_repeated_ids_fill_several_files(spark, tmp_path, monkeypatch):
    """1,000 pages without an id and 1,000 with one id: no file holds most of them, and every record has its own id."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(None, f"http://n/{i}", f"page {i % 700} " + "x" * 50) for i in range(1000)] + [(7, f"http://r/{i}", f"again {i % 600} " + "y" * 50) for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    scratch = Scratch(spark, "test")
    warc.write_arc(pages, f"file://{tmp_path}/arc", scratch)
    per_file = [sum(1 for _ in warc.parse_arc(warc._inflated(p.read_bytes()))) for p in (tmp_path / "arc").glob("part-*")]
    assert sum(per_file) == 2000 and len(per_file) >= 5 and max(per_file) < 900
    warc.convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc", scratch)
    headers = [h for p in (tmp_path / "warc").glob("part-*") for h, _ in warc.parse_warc(warc._inflated(p.read_bytes()))]
    ids = {h["warc-record-id"]: h for h in headers}
    assert len(headers) == len(ids) == 2000
    for h in headers:
        if h["warc-type"] == "revisit":  # it names a response with the same payload
            other = ids[h["warc-refers-to"]]
            assert other["warc-type"] == "response" and other["warc-payload-digest"] == h["warc-payload-digest"]
    kinds = [h["warc-type"] for h in headers if "http://r/" in h["warc-target-uri"]]
    assert kinds == ["response"] * 1000  # rows of one page_id revisit none of their own
    assert sum(h["warc-type"] == "revisit" for h in headers) == 300


def test_pages_of_a_large_host_are_split(spark):
    """Nine tenths of the pages on one host: the join with the blocked hosts is a skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pages = spark.range(60_000).selectExpr("id AS page_id", "concat('http://', IF(id % 10 < 9, 'big.example', concat('h', id % 500, '.net')), '/p', id) AS url").repartition(12)
        outcomes = spark.range(60_000).where("id % 3 = 0").selectExpr("id AS page_id", "CAST(id % 10 < 9 AS INT) AS bad")
        judged = url_filter.filter_urls(pages, outcomes)
        got = {r["verdict"]: r["n"] for r in judged.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        assert got == {"block": 54_000, "allow": 6_000}
        judged.toArrow()
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
