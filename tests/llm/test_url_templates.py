import re

from strata.llm.queries import URL_RULES, op9_url_templates
from strata.llm.url_templates import Rule, TemplateRules, filter_urls

RULES = [Rule.parse(*r) for r in URL_RULES]
SCHEMA = "page_id bigint, url string"


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def plain_shape(path):
    out = []
    for p in path.removeprefix("/").split("/"):
        if m := re.fullmatch(r"[0-9]+((?:\.[A-Za-z]+)?)", p):
            p = "{n}" + m[1]
        elif re.fullmatch(r"(?=.*[0-9])[0-9A-Fa-f-]{8,}", p):
            p = "{h}"
        out.append(p)
    return out


def plain_purities(parsed, k=TemplateRules()):
    """(host, shape) -> purity of its template, for hosts with enough labels; ``parsed`` has (host, path, verdict or None)."""
    bad = sum(v == "block" for _, _, v in parsed)
    prior, out = bad / max(1, sum(v is not None for _, _, v in parsed)), {}

    def count(rows):
        return sum(v == "block" for _, v in rows), sum(v == "allow" for _, v in rows)

    def grow(host, rows, depth, parent):
        b, g = count(rows)
        own = (b + k.prior_weight * parent) / (b + g + k.prior_weight)
        if not (b and g):
            out.update({(host, tuple(s)): own for s, _ in rows})
            return
        kids = {}
        for s, v in rows:
            kids.setdefault(s[depth] if depth < len(s) else None, []).append((s, v))
        if ended := kids.pop(None, None):
            b, g = count(ended)
            out.update({(host, tuple(s)): (b + k.prior_weight * own) / (b + g + k.prior_weight) for s, _ in ended})
        below = {}
        if len(kids) >= k.min_children and len(kids) >= k.variable_share * sum(map(len, kids.values())):
            below["*"] = [r for rows in kids.values() for r in rows]
        else:
            counts = {c: count(r) for c, r in kids.items()}
            sides = {c: b / (b + g) >= 0.5 for c, (b, g) in counts.items() if b + g >= k.min_labels}
            for c, r in kids.items():
                name = "=" + c
                if c in sides:
                    pool = [counts[o] for o in sides if sides[o] == sides[c]]
                    rate = sum(b for b, _ in pool) / sum(b + g for b, g in pool)
                    b, g = counts[c]
                    if abs(b / (b + g) - rate) <= k.z * (rate * (1 - rate) / (b + g)) ** 0.5 + 1e-12:
                        name = f"+{sides[c]}"
                below.setdefault(name, []).extend(r)
        for r in below.values():
            grow(host, r, depth + 1, own)

    hosts = {}
    for host, path, verdict in parsed:
        if host:
            hosts.setdefault(host, []).append((plain_shape(path), verdict))
    for host, rows in hosts.items():
        if sum(count(rows)) >= k.min_labels:
            grow(host, rows, 0, prior)
    return out


def plain_verdicts(urls, rules):
    global RULES
    kept, RULES = RULES, rules
    parsed = [(*(x := plain_rule(u))[:2], x[3]) for u in urls]
    RULES = kept
    purity = plain_purities(parsed)
    return [v or ("block" if purity.get((h, tuple(plain_shape(p))), 0) >= 0.8 else "allow") for h, p, v in parsed]


def odd_urls():
    return [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/2", "http://www.example.com/en/3",
        "https://a.net/es/4", "https://net/fr/5#t", "ftp://Ä.net/fr", "http://com", "http://com/", "http://xcom/", "http://a.com?b/", "x://y://z.com/",
        "http://a.org/" + "deep/" * 3_000, "http://a.org//", "http://a.org/p.html#://b.net/fr/",
    ]


def test_rules_match_brute_force(spark):
    rows = list(enumerate(odd_urls())) + [(None, "http://a.com/"), (3, "http://")]
    got = filter_urls(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    key = str
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(((i, *plain_rule(u)[:3]) for i, u in rows), key=key)
    verdicts = plain_verdicts([u for _, u in rows], RULES)
    assert sorted(((r.page_id, r.host, r.path, r.verdict) for r in got), key=key) == sorted(
        ((i, *plain_rule(u)[:2], v) for (i, u), v in zip(rows, verdicts)), key=key
    )


def test_labels_that_differ_deep_down_tell_templates_apart(spark):
    rules = [Rule("block", "a.org", "/1x/2x/3x/4x/5x/6x/bad"), Rule("allow", "a.org", "/1x/2x/3x/4x/5x/6x/good/q")]
    urls = [f"http://a.org/1x/2x/3x/4x/5x/6x/{c}/{x}{k}" for k in range(40) for c, x in (("bad", "p"), ("good", "p"), ("good", "q"))]
    rows = list(enumerate(urls))
    got = [r.verdict for r in sorted(filter_urls(spark.createDataFrame(rows, SCHEMA), rules).collect(), key=lambda r: r.page_id)]
    assert got == plain_verdicts(urls, rules)
    assert {(u.split("/")[9], v) for u, v in zip(urls, got)} == {("bad", "block"), ("good", "allow")}


def test_trees_match_brute_force(spark):
    import random

    rng = random.Random(8)
    rules = [Rule("block", "h.org", f"/{a}/{b}") for a in "abc" for b in ("x", "y1")] + [Rule("allow", "h.org", f"/{a}/z") for a in "abd"]
    urls = []
    for _ in range(1_500):
        parts = [rng.choice("abcdef"), rng.choice(["x", "y1", "y2", "z", "w", str(rng.randrange(99))]), f"{rng.choice('pq')}{rng.randrange(40)}"]
        urls.append(f"http://{rng.choice(['', '', 'm.', 'n.'])}h.org/" + "/".join(parts[: rng.randint(0, 3)]))
    got = [r.verdict for r in sorted(filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), rules).collect(), key=lambda r: r.page_id)]
    assert got == plain_verdicts(urls, rules)
    undecided = [g for g, u in zip(got, urls) if not re.search("/[abc]/(x|y1)|/[abd]/z", u)]
    assert {"block", "allow"} == set(undecided)


def test_templates_follow_labelled_purity(spark):
    rules = [Rule("block", "shop.org", "/tag/spam"), Rule("allow", "shop.org", "/item/ok")]
    urls = [f"http://shop.org/tag/spam{c}{k}/p" for k in range(30) for c in "xyz"]
    urls += [f"http://shop.org/tag/other{k}/p" for k in range(20)]
    urls += [f"http://shop.org/item/ok{k}" for k in range(40)] + [f"http://shop.org/item/new{k}" for k in range(10)]
    urls += [f"http://else.org/tag/spam{k}/p" for k in range(20)]
    got = {r.path if r.host == "shop.org" else r.host + r.path: r for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), rules).collect()}
    assert got["/tag/other3/p"].verdict == "block" and got["/tag/other3/p"].rule is None and got["/tag/other3/p"].purity >= 0.8
    assert got["/item/new3"].verdict == "allow"
    assert got["else.org/tag/spam3/p"].verdict == "allow"


def test_no_rules_empty_and_clashing_columns(spark):
    assert filter_urls(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    odd = spark.createDataFrame([(1, "http://a.b/c", 2, 3)], "page_id int, url string, host int, shape int")
    assert tuple(filter_urls(odd, []).first()) == (1, "a.b", "/c", None, "allow", None)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted((r.page_id, *plain_rule(r.url)[:3]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    rows = op9_url_templates(spark, sf).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in rows) == want
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    verdicts = dict(zip(urls, plain_verdicts(list(urls.values()), RULES)))
    assert {r.page_id: r.verdict for r in rows} == verdicts
    assert any(r.rule is None and r.verdict == "block" for r in rows)
