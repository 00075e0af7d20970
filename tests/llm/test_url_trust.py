import random
import re

import duckdb
import numpy as np
import pytest

from proofmill.llm import url_trust as U

PAGES = "page_id long, url string, html string, host string, verdict string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def solved(nodes, edges, seeds):
    """The limits as solutions of linear equations."""
    at = {h: n for n, h in enumerate(nodes)}
    links = np.zeros((len(nodes), len(nodes)))
    for (a, b), n in edges.items():
        links[at[a], at[b]] += n
    out = links.sum(axis=1, keepdims=True)
    links = np.divide(links, out, out=np.zeros_like(links), where=out > 0)
    s = np.array([seeds.get(h, (0.0, 0.0)) for h in nodes]).reshape(-1, 2)
    one = np.eye(len(nodes))
    # hosts without links send a walk back to the seeds
    back = np.where(out > 0, 0, s[:, 0] / max(s[:, 0].sum(), 1e-300))
    trust = np.linalg.solve(one - U.DAMPING * (links + back).T, (1 - U.DAMPING) * s[:, 0])
    distrust = np.linalg.solve(one - U.DAMPING * (1 - s[:, 1:]) * links, s[:, 1])
    return trust, distrust


def brute(pages):
    urls, edges = [], {}
    for page_id, url, html in pages:
        host, path = brute_parts(url)
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        urls.append((page_id, host, path, max(fits, key=lambda r: len(r.text)) if fits else None))
        for to in {h.lower() for h in re.findall(U.LINK, html or "")}:
            if host and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    seeds = {}
    for _, host, _, rule in urls:
        if host:
            s = seeds.setdefault(host, [0, 0, 0])
            s[2] += 1
            if rule:
                s[rule.verdict == "block"] += 1
    nodes = sorted(set(seeds) | {h for e in edges for h in e})
    trust, distrust = solved(nodes, edges, {h: (s[0] / s[2], s[1] / s[2]) for h, s in seeds.items()})
    score = {h: (trust[n], distrust[n]) for n, h in enumerate(nodes)}
    return [(i, h, p, r.text if r else None, r.verdict if r else "block" if h and score[h][1] >= U.THRESHOLD
                   and score[h][1] > score[h][0] else "allow") for i, h, p, r in urls]


def random_pages(seed):
    rng = random.Random(seed)
    hosts = ["a.net", "b.net", "net", "x.example.net", "example.com", "M.example.com", "c.org", "d.org", "e.info", "f.info",
             "g.info", "h.info", "notnet", "examplexnet"]
    rows = []
    for i in range(120):
        url = rng.choice(["http://", "https://", "x://"]) + rng.choice(hosts) + rng.choice(
            ["/en/1", "/de/2", "/fr/", "/", "", "?q=/de/", "#/fr/", "/en", "/x/en/"])
        links = "".join(rng.choice(['<a href="https://{}/x">', "<A HREF='//{}?q'>", "<a href=http://{}>", '<a href="/{}">'])
                        .format(rng.choice(hosts)) for _ in range(rng.randrange(4)))
        rows.append((i, url, links))
    return rows + [(900, None, None), (901, "no scheme", '<a href="http://a.net">'), (902, "://", ""), (902, "://", ""),
                   (None, "http://a.net/x", None), (903, "http://A.Net/a?b://c", "x" * 200_000)]


@pytest.mark.parametrize("seed", (1, 2))
def test_verdicts_equal_brute_force_and_sql(spark, seed):
    rows = random_pages(seed)
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], PAGES)
    columns = ("page_id", "host", "path", "rule", "verdict")
    got = sorted((tuple(r) for r in U.verdicts(pages).select(*columns).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert {r[4] for r in got if r[3] is None} == {"block", "allow"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    sql = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({U.oracle()})").fetchall()
    assert sorted(sql, key=repr) == got


def scores(spark, seeds, edges):
    rows = spark.createDataFrame([(h, float(t), float(d)) for h, (t, d) in seeds.items()], "host string, trust double, distrust double")
    links = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long")
    return {r["host"]: (r["trust"], r["distrust"]) for r in U.propagate(rows, links).collect()}


def test_trust_follows_links_and_distrust_runs_against_them(spark):
    got = scores(spark, {"good": (1, 0), "bad": (0, 1)}, {("good", "friend"): 1, ("ally", "bad"): 1, ("bad", "victim"): 1})
    assert got["good"][0] + got["friend"][0] == pytest.approx(1) and got["friend"] == (pytest.approx(.85 / 1.85), 0)
    assert got["ally"] == (0, pytest.approx(.85)) and got["bad"] == (0, 1) and got["victim"] == (0, 0)


def test_distrust_does_not_depend_on_how_many_link(spark):
    for linkers in (1, 2, 10):
        got = scores(spark, {"bad": (0, 1)}, {(f"l{i}", "bad"): 3 for i in range(linkers)})
        assert [got[f"l{i}"][1] for i in range(linkers)] == pytest.approx([.85] * linkers)


def test_mutual_links_do_not_add_up(spark):
    for share in (.142, .15):
        a, b = (scores(spark, {"a": (0, share)}, {("a", "b"): 1, ("b", "a"): 1})[h][1] for h in "ab")
        assert a == pytest.approx(share / (1 - (1 - share) * .85 ** 2)) and b == pytest.approx(.85 * a) and a < U.THRESHOLD


def test_a_chain_longer_than_twenty_hops_and_the_limit(spark):
    chain = {(f"h{i:02}", f"h{i + 1:02}"): 1 for i in range(45)} | {("h05", "h04"): 2, ("h30", "h02"): 1}
    seeds = {"h45": (0, 1), "h00": (1, 0), "h20": (.4, .3)}
    got = scores(spark, seeds, chain)
    nodes = sorted({h for e in chain for h in e})
    trust, distrust = solved(nodes, chain, seeds)
    assert [got[h][0] for h in nodes] == pytest.approx(trust, abs=1e-8)
    assert [got[h][1] for h in nodes] == pytest.approx(distrust, abs=1e-8) and got["h21"][1] > 0


def test_of_equally_long_rules_the_first_wins(spark):
    rules = (U.Rule("allow", "a.net", "/xy"), U.Rule("block", "net", "/xy/z"), U.Rule("block", "a.net", "/x"))
    pages = spark.createDataFrame([(1, "http://a.net/xy/z1", None, "h", "v")], PAGES)
    assert U.verdicts(pages, rules).first()["rule"] == "a.net/xy"
    rules = (U.Rule("allow", "a.net", "/xy"), U.Rule("block", "net", "/xy/"))
    assert [U.verdicts(pages, r).first()["verdict"] for r in (rules, rules[::-1])] == ["allow", "allow"]
    rules = (U.Rule("allow", "a.net", "/xy"), U.Rule("block", "a.net", "/xy"))
    assert [U.verdicts(pages, r).first()["verdict"] for r in (rules, rules[::-1])] == ["allow", "block"]


def test_empty_table(spark):
    assert U.verdicts(spark.createDataFrame([], PAGES)).count() == 0
