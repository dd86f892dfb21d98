import random
import re

from cosignal.llm import url_rules as U
from cosignal.llm.queries import URL_HOST_RULES, op8_url_rules

from .helpers import SF

RULES = [*(U.host_rule(*r) for r in URL_HOST_RULES), *U.DEFAULT_PATTERNS,
         U.Rule("any digits", r"/\d{5,}x", "block"), U.Rule("early", r"(?:foo|bar)baz", "allow", rank=1)]
URLS = ["http://a.net/x", "http://NET/x", "http://internet/x", "https://x.example.net/en/1", "https://example.net/EN/1",
        "https://example.net?x", "http://b.example.com/de/1?sessionid=4", "http://c.org/fr/", "http://c.org/fr", "x://org/fr/a",
        "http://h.io/login", "http://h.io/loginx", "http://h.io/a.zip?x", "http://h.io/azip", "http://casino.h.io/", "http://h.io/12345x",
        "http://h.io/foobaz/wp-admin/", "no scheme/login", "", None, "http://a.net:80/x", "http://u@a.net/x", "ftp://a://b.net/x",
        "http://h.io/é/login#x", "http://h.io/" + "a/" * 20000 + "wp-admin/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hit = [r for r in RULES if re.search(r.pattern, host + path if r.field == "place" else url or "")]
    best = min(hit, key=lambda r: (-r.rank, r.name), default=None)
    return host, path, best and best.name, best.action if best else "allow"


def test_rules_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] * 2,
                               "page_id long, url string, host string, rule string")
    got = U.judge_urls(df, RULES, df.columns).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.action) == brute(r.doc.url)
    assert U.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.action for r in U.judge_urls(df, []).collect()} == {"allow"}


def test_filter_lists_of_thousands(spark):
    """Rules in filter-list syntax: the verdicts are those of running every rule on every url, and
    few rules run."""
    rng = random.Random(12)
    word = lambda n=5: "".join(rng.choice("abcdefgh0123") for _ in range(rng.randint(2, n)))
    names = [word() for _ in range(300)]
    name = lambda: rng.choice(names)
    forms = [lambda: f"||{name()}.com^", lambda: f"||{name()}.{name()}.net/{name()}/*", lambda: f"/{name()}/*/{name()}^",
             lambda: f"|http://{name()}.org/{name()}|", lambda: f"@@||{name()}.com/{name()}/", lambda: f"-{name()}-*.js|",
             lambda: f"&{name()}=", lambda: f"{name()}.{name()}$match-case", lambda: f"/{name()}[0-9]+/", lambda: "! a comment"]
    lines = list(dict.fromkeys(rng.choice(forms)() for _ in range(3000)))
    rules = [r for r in map(U.filter_rule, lines) if r]
    assert 2000 < len(rules) < 3000
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', name() + '.'])}{name()}.{rng.choice(['com', 'net', 'org', name() + '.net'])}"
            f"{rng.choice(['', ':80'])}/{name()}/{rng.choice([name(), name().upper(), name() + '9'])}/{name()}{rng.choice(['', '.js', '-' + name() + '-x.js', '?a=1&' + name() + '=2', '#' + name()])}"
            for _ in range(400)]
    urls += [f"http://x.{line[4:]}index" for line in lines if line.startswith("@@||")][:20]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    compiled = [re.compile(r.pattern) for r in rules]
    verdicts = set()
    for r in U.judge_urls(df, rules, ["page_id", "url"]).collect():
        hit = [x for x, c in zip(rules, compiled) if c.search(r.doc.url)]
        best = min(hit, key=lambda x: (-x.rank, x.name), default=None)
        assert (r.rule, r.action) == ((best.name, best.action) if best else (None, "allow"))
        verdicts.add((r.action, best is not None))
    assert verdicts == {("allow", False), ("allow", True), ("block", True)}
    index, always = U.build_index(rules, {})
    run = [len(always) + sum(len(index.get(t, ())) for t in U.url_tokens(u)) for u in urls]
    assert sum(run) / len(run) < 0.35 * len(rules)


def test_filter_syntax():
    hits = lambda line, url: re.search(U.filter_rule(line).pattern, url) is not None
    assert hits("||ads.net^", "https://x.ads.net/") and hits("||ads.net^", "http://ADS.net") and hits("||ads.net^", "http://ads.net:80/")
    assert not hits("||ads.net^", "http://bads.net/") and not hits("||ads.net^", "http://ads.net.org/") and not hits("||ads.net^", "http://a.org/ads.net/")
    assert hits("|http://a.b/|", "http://a.b/") and not hits("|http://a.b/|", "http://a.b/c")
    assert hits("/ban*ner^", "http://x/ban/ner?x") and not hits("/ban*ner^", "http://x/ban/ners")
    assert not hits("Ads$match-case", "http://x/ads") and hits("Ads$match-case", "http://x/Ads")
    assert hits("/a[0-9]{2}/", "http://x/a12") and U.filter_rule("@@||a.b^").action == "allow" and U.filter_rule("@@||a.b^").rank == 1
    assert all(U.filter_rule(x) is None for x in ("", "! note", "[Adblock]", "a.com##.ad", "||a.b^$third-party", "*"))
    assert U.literal_tokens(U.filter_rule("||ads.net^").pattern) == {"ads", "net"}


def test_letter_case_of_the_own_patterns(spark):
    urls = ["HTTP://CASINO.com", "http://h.io/Login", "http://h.io/a.ZIP", "http://h.io/WP-Admin/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.action for r in U.judge_urls(df, list(U.DEFAULT_PATTERNS)).collect()} == {"block"}


def test_literal_tokens_stand_alone():
    assert U.literal_tokens(r"/login[/?#]") == {"login"}
    assert U.literal_tokens(r"track\.") == set()            # may be the end of a longer token
    assert U.literal_tokens(r"/a.*b/") == set()
    assert U.literal_tokens(r"/ab+/") == set()
    assert U.literal_tokens(U.host_rule("example.net", "/en/", "allow").pattern) == {"example", "net", "en"}


def test_rarest_token_is_the_key():
    rules = [U.host_rule("example.net", "/en/", "allow")]
    index, always = U.build_index(rules, {"example": 50, "net": 20, "en": 30})
    assert index == {b"net": [0]} and always == []


def test_query_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op8_url_rules(spark, SF).collect()
    assert len(got) == len(urls)
    longest = lambda h, p: max((x for x in URL_HOST_RULES if (h == x[0] or h.endswith("." + x[0])) and p.startswith(x[1])),
                               key=lambda x: len(x[0] + x[1]), default=None)
    for r in got:
        host, path, _, _ = brute(urls[r.page_id])
        best = longest(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1])
        if best:
            assert r.verdict == best[2]
