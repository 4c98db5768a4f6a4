from __future__ import annotations

import re

import cases
import pytest

from wearlog.llm import url_filter


def brute(rows: list[tuple], rules=url_filter.RULES, rounds=url_filter.ROUNDS, damping=url_filter.DAMPING) -> list[tuple]:
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(small), re.match(r"[^?#]*", rest[len(host) :])[0]

    named, edges, seeds, hosts = [], {}, {"allow": {}, "block": {}}, set()
    for page, url, html in rows:
        host, path = parts(url)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        named.append((page, host, path, best))
        if host:
            hosts.add(host)
            if best:
                seeds[best[0]][host] = seeds[best[0]].get(host, 0) + 1
            for link in re.findall(r"""(?i)href\s*=\s*["']([^"']*://[^"']*)["']""", html or ""):
                to = parts(link)[0]
                if to and to != host:
                    hosts.add(to)
                    edges[host, to] = edges.get((host, to), 0) + 1
    ups = set()
    for h in hosts:
        while "." in h:
            up = h.split(".", 1)[1]
            if h and "." in up:
                ups.add((h, up))
            h = up
    for a, b in ups:
        edges[a, b] = edges.get((a, b), 0) + 1
        edges[b, a] = edges.get((b, a), 0) + 1

    def rank(seed, links):
        total, out = sum(seed.values()), {}
        for (a, _), w in links.items():
            out[a] = out.get(a, 0) + w
        restart = {h: w / total * (1 - damping) for h, w in seed.items()}
        score = dict(restart)
        for _ in range(rounds):
            new = dict(restart)
            for (a, b), w in links.items():
                if a in score:
                    new[b] = new.get(b, 0) + score[a] * w / out[a] * damping
            score = new
        return score

    trust = rank(seeds["allow"], edges)
    distrust = rank(seeds["block"], {(b, a): w for (a, b), w in edges.items()})
    out = []
    for page, host, path, best in named:
        verdict = best[0] if best else "block" if round(distrust.get(host, 0), 9) > round(trust.get(host, 0), 9) else "allow"
        out.append((page, host, path, best[1] + best[2] if best else None, verdict))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_odd_pages(spark):
    link = '<a href="http://{}/x">y</a>'
    rows = [
        (1, "http://WWW.Example.com/en/1?x#y", link.format("bad.example.net")),
        (2, "https://a.example.com/en/", link.format("spam.org") * 3),
        (3, "https://a.example.com/fr/", None),
        (4, "http://bad.example.net/fr/x", link.format("spam.org") + link.format("good.org")),
        (5, "http://spam.org", link.format("bad.example.net")),
        (6, "http://good.org/", link.format("www.example.com")),
        (7, None, link.format("spam.org")),
        (8, "no scheme", ""),
        (8, "no scheme", ""),
        (None, "ftp://notexample.com/en/?a", ""),
        (9, "http://com/", ""),
        (10, "http://com", ""),
        (11, "http://?q", link.format("")),
        (12, "x\ny://h.net/es/\nz?", "<A HREF='https://H.net/fr/'>"),
        (13, "http://a://b/en/", ""),
        (14, "http://x..org./p", ""),
    ]
    full = [(*r, "z", 1.0) for r in rows]
    df = spark.createDataFrame(full, "page_id long, url string, html string, host string, score double").repartition(3)
    assert found(url_filter.judge(df)) == brute(rows)
    assert found(url_filter.judge(df.where("false"))) == []


def test_sites_of_a_top_level_domain_are_no_neighbours(spark):
    rows = [(k, f"http://bad{k}.net/fr/", None) for k in range(5)]
    rows += [(10, "http://a.good.net/x", None), (11, "http://good.net/en/", None), (12, "http://www.bad1.net/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert {k: judged[k].verdict for k in (10, 11, 12)} == {10: "allow", 11: "allow", 12: "block"}
    assert judged[10].distrust == 0 and found(url_filter.judge(df)) == brute(rows)
    edges = url_filter.host_edges(df.selectExpr("split(url, '/')[2] as host", "html"))
    assert {(r.src, r.dst) for r in edges.collect()} == {
        (a, b) for x, y in (("a.good.net", "good.net"), ("www.bad1.net", "bad1.net")) for a, b in ((x, y), (y, x))
    }


def test_verdicts_do_not_depend_on_the_number_of_other_seeds(spark):
    few = [(k, f"http://bad.site.net/fr/{k}", None) for k in range(2)]
    few += [(10 + k, f"http://s{k}.site.net/x", None) for k in range(1000)]
    df = spark.createDataFrame(few, "page_id long, url string, html string")
    many = spark.range(1_000_000).selectExpr("id + 100000 as page_id", "'http://far.example.com/en/' as url", "cast(null as string) as html")
    rules = (("block", "net", "/fr/"), ("block", "example.com", "/en/"))
    of = lambda pages: {r.page_id: r.verdict for r in url_filter.judge(pages, rules).where("page_id < 100000").collect()}
    alone, among = of(df), of(df.union(many))
    assert alone == among and set(alone.values()) == {"block"}


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in cases.table("pages", cases.MIDDLE)]
    assert found(url_filter.judge(spark.read.parquet(f"{cases.MIDDLE}/pages.parquet"))) == brute(rows)
