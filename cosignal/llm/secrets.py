"""Secret scans: known formats, and windows of high entropy.

Known formats are regular expressions (``BASE``). The method then looks at candidate
strings, runs of a character class: a window slides over the candidate, and the counts of
its characters are kept up to date by adding the one that enters and removing the one that
leaves. The counts are packed, 12 to a 64-bit word, so a step rewrites seven words, not one slot
per character. With f(n) = n log2 n the window's Shannon entropy is log2 W - (sum of f(count)) / W,
so only the sum has to follow two counts per step. f is held in integers (units of 2^-32
bit), so nothing drifts. Windows at or above the class's threshold are united into spans,
unless the whole candidate is on the allow-list, the window touches a placeholder or holds
a ruler, or a known format already covers the span.

SQL's arrays are copied whenever one is appended to, so nothing here appends to a list as long
as the text: matches are placed, and candidates slid over, in pieces of bounded length, and
the pieces' results are flattened once.

DataFrame and SQL functions only; a row never leaves its task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosignal.llm.common import column

#: kind -> (pattern, group whose length counts, least length), leftmost non-overlapping.
BASE = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
               r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),   # runs are maximal, so shorter ones may be skipped here
}


@dataclass(frozen=True)
class CharClass:
    """Candidates are maximal runs of ``chars`` of at least ``window`` characters."""
    kind: str
    chars: str
    window: int
    bits: float          # windows with at least this entropy are hot


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.9),
)
#: Whole candidates that are no secrets: words, alone, joined or in camel case, and numbers.
#: Letters whose case follows no word's shape are no word.
TWO = "By|Of|Is|To|In|On|At|It|An|My|As|Or|Id|No|Do|Up|We|If|So|Go|Be|He|Me|Us"
WORD = rf"(?:(?:{TWO})(?![a-z])|[A-Z]?[a-z]{{2,}}+|[A-Z]{{2,}}+|[A-Za-z](?![A-Za-z]))++"
ALLOW = (rf"\A{WORD}(?:[-_/=+]{WORD})*+[-_/=+]*\z", r"\A[0-9]+\z")
#: UUIDs, documented placeholders and alphabets inside a candidate: windows that touch one
#: do not count, what stands beside it does.
PLACEHOLDER = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
               r"|(?i:example|placeholder|changeme|x{4,}|0123456789abcdef(?:ghijklmnop)?|abcdefghijklmnop)")
#: Windows that hold a ruler do not count. A part of one adds no entropy, so windows that
#: only touch it are left to their entropy.
RULER_CHARS = 8
RULER = rf"(.)\1{{{RULER_CHARS - 1}}}"
LOW, HIGH = ord("+"), ord("z")     # all class characters lie in this ASCII range
SCALE = 2 ** 32
PACK, COUNT_BITS = 12, 5           # counts in a 64-bit word; a window has fewer than 32 characters
CHUNK = 256                        # matches placed together
STRETCH = 2048                     # window starts slid over together


def _steps(window: int) -> list[int]:
    return [0, *(round(n * math.log2(n) * SCALE) for n in range(1, window + 1))]


def limit(window: int, bits: float) -> int:
    """Largest sum of f(count) at which a window is still hot."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _literal(s: str) -> str:
    return "r'" + s.replace("'", "''") + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(name: str, value: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunked(array: str) -> str:
    """SQL for a non-empty array cut into arrays of ``CHUNK``."""
    return f"transform(sequence(0, (size({array}) - 1) div {CHUNK}), c -> slice({array}, c * {CHUNK} + 1, {CHUNK}))"


def matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL for all matches of ``pattern`` in the column ``text``: array of (start, stop,
    size), in code points; ``size`` is the length of the match's ``group``. The text between
    matches (split) and the matches give the lengths, their running sum the positions: first
    over whole chunks, then within each."""
    p = _literal(pattern)
    found, gaps = f"regexp_extract_all({text}, {p}, 0)", f"split({text}, {p})"
    sized = f"regexp_extract_all({text}, {p}, {group})"
    lengths = f"""arrays_zip(transform({gaps}, g -> length(g)), transform({found}, f -> length(f)),
                            transform({sized}, f -> length(f)))"""
    begins = """aggregate(parts, named_struct('at', 0, 'out', cast(array() as array<int>)),
      (acc, part) -> named_struct('at', acc.at + aggregate(part, 0, (s, x) -> s + x['0'] + coalesce(x['1'], 0)),
                                  'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""
    place = """aggregate(part, named_struct('at', begin, 'out', cast(array() as array<struct<start:int,stop:int,size:int>>)),
      (acc, x) -> if(x['1'] is null, acc, named_struct(
        'at', acc.at + x['0'] + x['1'],
        'out', concat(acc.out, array(named_struct('start', acc.at + x['0'], 'stop', acc.at + x['0'] + x['1'], 'size', x['2']))))),
      acc -> acc.out)"""
    return bound("lengths", lengths, bound("parts", chunked("lengths"), (
        f"flatten(zip_with(parts, {begins}, (part, begin) -> {place}))")))


def pieces(candidate: str, window: int) -> str:
    """SQL for the parts of the string ``candidate`` between placeholders that hold a window
    at least: array of (start, chars), ``chars`` an array of one-character strings."""
    return f"""transform(filter(transform(
        array({matches(candidate, PLACEHOLDER)}),
        found -> zip_with(concat(array(0), transform(found, p -> p.stop)),
                          concat(transform(found, p -> p.start), array(length({candidate}))),
                          (a, b) -> named_struct('start', a, 'stop', b)))[0], p -> p.stop - p.start >= {window}),
      p -> named_struct('start', p.start, 'chars', split(substr({candidate}, p.start + 1, p.stop - p.start), '')))"""


def united(spans: str) -> str:
    """SQL for sorted spans (start, stop) with those that overlap or touch made one: the starts of
    spans that begin after the one before, with the stops of those before which one begins."""
    apart = lambda a, b: f"get(s, {a}).stop < get(s, {b}).start"
    return bound("s", spans, f"""zip_with(
      filter(transform(s, (x, i) -> if(i = 0 or {apart('i - 1', 'i')}, x.start, -1)), x -> x >= 0),
      filter(transform(s, (x, i) -> if(i = size(s) - 1 or {apart('i', 'i + 1')}, x.stop, -1)), x -> x >= 0),
      (a, b) -> named_struct('start', a, 'stop', b))""")


def hot_spans(chars: str, c: CharClass) -> str:
    """SQL for the united hot windows of ``chars``, an array of at least a window of
    one-character strings: array of (start, stop)."""
    stretch = f"""transform(sequence(0, (size({chars}) - {c.window}) div {STRETCH}), k ->
        named_struct('begin', k * {STRETCH}, 'chars', slice({chars}, k * {STRETCH} + 1, {STRETCH + c.window - 1})))"""
    return united(f"""flatten(transform({stretch}, part -> transform({_slide('part.chars', c)}, s ->
        named_struct('start', part.begin + s.start, 'stop', part.begin + s.stop))))""")


def _slide(chars: str, c: CharClass) -> str:
    """SQL for the united hot windows of a stretch of bounded length."""
    w, table = c.window, "array(" + ",".join(f"{v}L" for v in _steps(c.window)) + ")"
    slot = lambda ch: f"(ascii({ch}) - {LOW})"
    count = lambda x: f"cast(shiftright(was.n[{x} div {PACK}], ({x} % {PACK}) * {COUNT_BITS}) & {2 ** COUNT_BITS - 1} as int)"
    one = lambda x, j: f"if({j} = {x} div {PACK}, shiftleft(1L, ({x} % {PACK}) * {COUNT_BITS}), 0L)"
    ruled = ""
    if w >= RULER_CHARS and _steps(w)[RULER_CHARS] <= limit(w, c.bits):    # else such windows are never hot
        ruled = f" and not rlike(array_join(slice({chars}, x.i - {w - 1}, {w}), ''), {_literal(RULER)})"
    push = "if(acc.stop > 0, concat(acc.out, array(named_struct('start', acc.start, 'stop', acc.stop))), acc.out)"
    return f"""aggregate(
      transform({chars}, (ch, i) -> named_struct(
        'i', i + 1, 'into', {slot('ch')}, 'gone', if(i >= {w}, {slot(f"get({chars}, i - {w})")}, -1))),
      named_struct('n', array_repeat(0L, {(HIGH - LOW) // PACK + 1}), 'sum', 0L, 'start', 0, 'stop', 0,
                   'out', cast(array() as array<struct<start:int,stop:int>>)),
      (was, x) -> element_at(transform(array(named_struct(
          'n', if(x.gone = x.into, was.n, transform(was.n, (v, j) ->
                 v + {one('x.into', 'j')} - if(x.gone >= 0, {one('x.gone', 'j')}, 0L))),
          'sum', if(x.gone = x.into, was.sum, was.sum
            - if(x.gone >= 0, {table}[{count('x.gone')}] - {table}[{count('x.gone')} - 1], 0L)
            + {table}[{count('x.into')} + 1] - {table}[{count('x.into')}]),
          'start', was.start, 'stop', was.stop, 'out', was.out)),
        acc -> if(x.i >= {w} and acc.sum <= {limit(w, c.bits)}L{ruled},
          if(acc.stop > 0 and x.i - {w} <= acc.stop,
            named_struct('n', acc.n, 'sum', acc.sum, 'start', acc.start, 'stop', x.i, 'out', acc.out),
            named_struct('n', acc.n, 'sum', acc.sum, 'start', x.i - {w}, 'stop', x.i, 'out', {push})),
          acc)), 1),
      acc -> {push})"""


def scan(docs: DataFrame, carry: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(doc struct of ``carry``, spans): one row per input row; ``spans`` is an array of
    (start, kind_no, kind, stop) in code points, stop exclusive, sorted by start, then kind
    in the order of ``BASE`` and ``CLASSES``.

    Null and empty texts have no spans; repeated rows are scanned alike; long texts are
    scanned whole; carried columns stay in ``doc``, so their names do not matter.
    """
    given = docs.select(F.struct(*[docs[c] for c in carry]).alias("doc"),
                        F.coalesce(column(docs, text, "string"), F.lit("")).alias("_t"))
    empty = F.expr("cast(array() as array<struct<start:int,kind_no:int,kind:string,stop:int>>)")
    for no, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found = F.transform(F.filter(F.expr(matches("_t", pattern, group)), lambda m: m["size"] >= least),
                            lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"),
                                               F.lit(kind).alias("kind"), m["stop"].alias("stop")))
        given = given.withColumn(f"_{kind}", F.when(F.col("_t").rlike(pattern), found).otherwise(empty))
    base = F.concat(*[F.col(f"_{kind}") for kind in BASE])
    given = given.select("doc", "_t", base.alias("_base"))
    for no, c in enumerate(CLASSES, len(BASE)):
        run = f"[{c.chars}]{{{c.window},}}"
        candidate = "substr(_t, m.start + 1, m.stop - m.start)"
        allowed = " or ".join(f"rlike({candidate}, {_literal(p)})" for p in ALLOW)
        found = F.expr(f"""flatten(transform(
          filter({matches('_t', run)}, m -> not ({allowed})),
          m -> flatten(transform({pieces(candidate, c.window)}, p -> transform({hot_spans('p.chars', c)}, s -> named_struct(
            'start', m.start + p.start + s.start, 'kind_no', {no}, 'kind', '{c.kind}',
            'stop', m.start + p.start + s.stop))))))""")
        given = given.withColumn(f"_{c.kind}", F.when(F.col("_t").rlike(run), found).otherwise(empty))
    # Chunks of the sorted base spans; a span is looked up in those that reach it.
    blocks = F.expr(f"""if(size(_base) = 0, cast(array() as array<struct<low:int,high:int,spans:array<struct<start:int,stop:int>>>>),
        {bound('b', "transform(array_sort(_base), x -> named_struct('start', x.start, 'stop', x.stop))",
               f"transform({chunked('b')}, p -> named_struct('low', p[0].start, 'high', array_max(transform(p, x -> x.stop)), 'spans', p))")})""")
    given = given.withColumn("_blocks", blocks)
    given = given.withColumn("_more", F.concat(*[F.col(f"_{c.kind}") for c in CLASSES]))
    more = F.expr("filter(_more, s -> not exists(_blocks, b -> b.low <= s.start and b.high >= s.stop "
                  "and exists(b.spans, x -> x.start <= s.start and x.stop >= s.stop)))")
    return given.select("doc", F.array_sort(F.concat("_base", more)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
