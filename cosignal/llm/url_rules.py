"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression with an action. Its literal tokens are the runs of letters
and digits that must stand alone, between separators, in every text it matches. Spark
counts in how many URLs each rule token occurs, and the rule is filed under its rarest
one. To judge a URL its own tokens are looked up, and only the rules filed under them run.
Rules without such a token are run on every URL, so no match is lost.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosignal.llm.common import column

TOKEN = re.compile(rb"[0-9a-z]+")
MAX_RULE_BYTES = 64 * 1024 * 1024     # rules travel to every task


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``pattern`` is searched in ``field``: 'place' is host + path,
    'url' the whole url. Among matching rules the one of the highest ``rank`` wins, then
    the first by name."""
    name: str
    pattern: str
    action: str                # allow or block
    field: str = "url"
    rank: int = 0


def host_rule(host: str, path: str, action: str) -> Rule:
    """A rule for a host and all its subdomains, for paths that begin with ``path``; longer
    rules outrank shorter ones, and all of them outrank plain pattern rules (rank 0)."""
    return Rule(host + path, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", action,
                "place", len(host + path))


#: The method's own pattern rules, for urls that no host rule decides.
DEFAULT_PATTERNS = (
    *(Rule(f"download {x}", rf"(?i)\.{x}(?:[?#]|\Z)", "block") for x in ("exe", "zip", "apk", "iso", "dmg")),
    *(Rule(x, rf"(?i)/{x}(?:[/?#]|\Z)", "block") for x in ("login", "signin", "checkout")),
    Rule("session", r"(?i)[?&]sessionid=", "block"),
    Rule("wp-admin", r"(?i)/wp-admin/", "block"),
    Rule("casino", r"(?i)//(?:[^/?#]*\.)?casino\.", "block"),
)

#: Pieces of filter-list rules: the end of a name or the url; the start of a host name or of one
#: of its domains.
SEPARATOR = r"(?:[^0-9A-Za-z_.%-]|\Z)"
HOST_START = r"\A[A-Za-z][0-9A-Za-z+.-]*://(?:[^/?#]*\.)?"


def filter_rule(line: str, exception_rank: int = 1) -> Rule | None:
    """A line of a filter list as a rule, or None for comments, empty lines and lines about page
    elements or with options (other than ``match-case``), which do not judge urls alone.

    ``||`` starts at a domain of the host, ``|`` is the url's start or end, ``*`` any characters,
    ``^`` a separator or the end; letter case does not matter unless ``$match-case`` is given;
    ``@@`` allows and outranks blocking rules. A line between slashes is a regular expression.
    """
    body, _, options = line.strip().partition("$") if not line.strip().endswith("$/") else (line.strip(), "", "")
    if not body or body[0] in "![" or "##" in body or "#@#" in body or options not in ("", "match-case"):
        return None
    allow = body.startswith("@@")
    text = body.removeprefix("@@")
    flags = "" if options else "(?i)"
    if len(text) > 2 and text[0] == text[-1] == "/":
        return Rule(line, flags + text[1:-1], "allow" if allow else "block", "url", exception_rank * allow)
    start = HOST_START if text.startswith("||") else r"\A" if text.startswith("|") else ""
    text = text.removeprefix("||" if text.startswith("||") else "|")
    end = r"\Z" if text.endswith("|") else ""
    text = text.removesuffix("|")
    parts = re.split(r"([*^])", text.strip("*") if not (start or end) else text)
    pattern = "".join(".*" if p == "*" else SEPARATOR if p == "^" else re.escape(p) for p in parts)
    if not pattern:
        return None
    return Rule(line, flags + start + pattern + end, "allow" if allow else "block", "url", exception_rank * allow)


def literal_tokens(pattern: str) -> set[str]:
    """Lower-case letter-digit runs that are whole tokens of every match: literals in a row
    with a separator, an anchor or the pattern's fixed separator class on either side."""

    def alnum(code: int) -> bool:
        return code < 128 and chr(code).isalnum()

    def separator(item) -> bool:
        kind, arg = item
        if kind is op.LITERAL:
            return arg < 128 and not alnum(arg)
        if kind is op.AT:
            return arg in (op.AT_BEGINNING_STRING, op.AT_END_STRING)
        if kind is op.IN:
            if arg[0][0] is op.NEGATE:        # a class that leaves out all letters and digits
                out = {c for k, v in arg[1:] for c in
                       (range(v[0], v[1] + 1) if k is op.RANGE else [v] if k is op.LITERAL else ())}
                return all(c in out for c in range(128) if alnum(c))
            return all(k is op.LITERAL and v < 128 and not alnum(v) for k, v in arg)
        if kind is op.SUBPATTERN:
            return len(arg[3]) == 1 and separator(arg[3][0])
        if kind is op.BRANCH:
            return all(len(b) == 1 and separator(b[0]) for b in arg[1])
        return False

    found: set[str] = set()
    run, open_ = "", False     # open_: the run began right after a separator
    for item in parser.parse(pattern):
        kind, arg = item
        if kind is op.LITERAL and alnum(arg):
            run += chr(arg).lower()
            continue
        if run and open_ and separator(item):
            found.add(run)
        # An optional prefix that ends in a separator, or is absent at the very start of
        # the text, still leaves a boundary before what follows.
        optional = kind is op.MAX_REPEAT and len(arg[2]) > 0 and separator(arg[2][-1])
        open_ = separator(item) or (optional and not run and open_)
        run = ""
    return found


def url_tokens(url: str | None) -> set[bytes]:
    return set(TOKEN.findall((url or "").encode("utf-8", "replace").lower()))


def token_counts(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """In how many rows each of ``tokens`` occurs in the url; at most one number a token
    reaches the driver."""
    if not tokens:
        return {}
    lowered = F.translate(column(pages, url, "string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[0-9a-z]+"), F.lit(0)))
    wanted = F.array(*[F.lit(t) for t in sorted(tokens)])
    found = (pages.select(F.explode(F.array_intersect(own, wanted)).alias("token"))
             .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())
    return {r.token: r.n for r in found}


def build_index(rules: list[Rule], counts: dict[str, int]
                ) -> tuple[dict[bytes, list[int]], list[int]]:
    """(token -> numbers of the rules filed under it, rules to run on every url)."""
    index: dict[bytes, list[int]] = defaultdict(list)
    always = []
    for i, rule in enumerate(rules):
        tokens = literal_tokens(rule.pattern)
        if tokens:
            index[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)).encode()].append(i)
        else:
            always.append(i)
    return dict(index), always


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z in lower case; the path goes on up to ``?``, ``#`` or the end. Both are
    empty without ``://`` or for a null url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    at = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host = host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return host, rest[:at]


def judge_urls(pages: DataFrame, rules: list[Rule], carry: list[str] = ("page_id",),
               url: str = "url", default: str = "allow") -> DataFrame:
    """(doc struct of ``carry``, host, path, rule, rule_rank, action): the winning rule's
    name, rank and action; without a match rule and rank are null and the action is
    ``default``.

    Null urls and urls without ``://`` have an empty host and path and no place rule
    matches them; repeated rows are judged alike; an empty table gives no rows. The rules
    are a list on the driver, at most ``MAX_RULE_BYTES`` of text.
    """
    rules = list(rules)
    if sum(len(r.pattern) + len(r.name) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"rules hold more than {MAX_RULE_BYTES} bytes")
    wanted = set().union(*(literal_tokens(r.pattern) for r in rules)) if rules else set()
    index, always = build_index(rules, token_counts(pages, wanted, url))
    given = pages.select(F.struct(*[pages[c] for c in carry]).alias("doc"),
                         column(pages, url, "string").alias("_url"))
    schema = T.StructType([given.schema["doc"]])
    for name, kind in (("host", "string"), ("path", "string"), ("rule", "string"),
                       ("rule_rank", "integer"), ("action", "string")):
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}

        def matches(i: int, place: str, address: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(rules[i].pattern)
            return compiled[i].search(place if rules[i].field == "place" else address) is not None

        for batch in batches:
            rows = []
            for address in batch.column("_url").to_pylist():
                host, path = split_url(address)
                candidates = {*always, *(i for t in url_tokens(address) for i in index.get(t, ()))}
                hit = [i for i in candidates if matches(i, host + path, address or "")]
                best = min(hit, key=lambda i: (-rules[i].rank, rules[i].name), default=None)
                rows.append((host, path, None, None, default) if best is None else
                            (host, path, rules[best].name, rules[best].rank, rules[best].action))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc", "host", "path", "rule", "rule_rank", "action"])

    return given.mapInArrow(run, schema)
