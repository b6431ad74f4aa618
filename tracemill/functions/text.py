"""Text functions: normalisation, answers, actions, mark-up, budgets, ratios.

Built-in expressions where they can say it; Arrow UDFs for Unicode folding, matching
blocks, compression, mark-up, and ordered budget rules. Null in, null out, unless stated.
"""

from __future__ import annotations

import bz2
import gzip
import html.parser
import json
import lzma
import re
import unicodedata
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _typed(f, kind: T.DataType):
    """An Arrow UDF over one column; None stays None."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


def fold(text: Column) -> Column:
    """NFKC and case folding."""
    return _typed(lambda x: unicodedata.normalize("NFKC", x).casefold(), T.StringType())(text)


def normal_query(text: Column) -> Column:
    """Folded; names of the currency as 元, also after a number; separating marks as blanks; blanks squeezed."""
    money = F.regexp_replace(F.regexp_replace(fold(text), "人民币|块钱", "元"), r"(?<=\d)\s*(?:rmb|cny|yuan)\b", "元")
    return F.trim(F.regexp_replace(F.regexp_replace(money, r"[，,。；;：:！!？?、|]", " "), r"\s+", " "))


def model_numbers(text: Column) -> Column:
    """Distinct tokens of a normal query, in their order, that have a letter and a digit; parts are joined by . _ + - /."""
    pattern = r"(?<![a-z0-9])(?=[a-z0-9._+\-/]*[a-z])(?=[a-z0-9._+\-/]*\d)[a-z0-9]+(?:[._+\-/][a-z0-9]+)*(?![a-z0-9])"
    return F.array_distinct(F.regexp_extract_all(normal_query(text), F.lit(pattern), F.lit(0)))


def option_text(text: Column) -> Column:
    """Folded, slashes as bars, no blanks."""
    return F.regexp_replace(F.replace(fold(text), F.lit("/"), F.lit("|")), r"\s+", "")


def title_terms(text: Column) -> Column:
    """Latin words and numbers, then pairs of neighbouring Han characters (a lone one by itself)."""
    latin = F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9]+(?:[._+\-/][a-z0-9]+)*"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[\u3400-\u4dbf\u4e00-\u9fff]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substr(r, i, F.lit(2)))
    return F.concat(latin, F.flatten(F.transform(runs, pairs)))


def option_document(options: Column) -> Column:
    """Axes in order, each followed by its visible values, of a map axis -> values."""
    entries = F.array_sort(F.map_entries(options))
    shown = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.concat(shown(F.array(e["key"])), shown(e["value"])))), " ")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no blanks, non-ASCII kept; NULL for what is no JSON."""

    def one(x):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return _typed(one, T.StringType())(text)


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def flatten_values(text: Column) -> Column:
    """All scalars of a JSON text in sorted-key order, joined by blanks."""

    def walk(v):
        if isinstance(v, dict):
            for k in sorted(v):
                yield from walk(v[k])
        elif isinstance(v, list):
            for x in v:
                yield from walk(x)
        elif v is not None and v != "":
            yield str(v).lower() if isinstance(v, bool) else str(v)

    def one(x):
        try:
            return " ".join(walk(json.loads(x)))
        except ValueError:
            return None

    return _typed(one, T.StringType())(text)


def drop_keys(text: Column, names: list[str]) -> Column:
    """JSON without the named keys at any depth."""
    gone = set(names)

    def strip(v):
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in gone}
        return [strip(x) for x in v] if isinstance(v, list) else v

    def one(x):
        try:
            return json.dumps(strip(json.loads(x)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return _typed(one, T.StringType())(text)


_METHODS = {"zlib": zlib.compress, "gzip": lambda b: gzip.compress(b, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}


def compression_ratio(text: Column, method: str = "zlib") -> Column:
    """Bytes before over bytes after; 0 for an empty text."""
    pack = _METHODS[method]
    return _typed(lambda x: len(b := x.encode()) / len(pack(b)) if x else 0.0, T.DoubleType())(text)


def is_repetitive(text: Column, least: int = 10_000, ratio: float = 10.0) -> Column:
    """Long texts whose last ``least`` characters compress more than ``ratio`` times (the window is the rule's own)."""
    return (F.length(text) > least) & (compression_ratio(F.substring(text, -least, least)) > ratio)


def _token_set_ratio(a: str, b: str) -> float:
    """0 to 100, whole: the best matching-block ratio among the shared words and each side's sorted words."""
    words = lambda t: set(re.sub(r"\W+", " ", t.casefold()).split())
    sa, sb = words(a), words(b)
    both = " ".join(sorted(sa & sb))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s - o))])) for s, o in ((sa, sb), (sb, sa)))
    pairs = [(both, left), (both, right), (left, right)] if both else [(left, right)]
    return float(max(round(100 * SequenceMatcher(None, x, y).ratio()) for x, y in pairs))


def token_set_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _token_set_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, blanks squeezed."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the word multisets of two normal answers; yes, no and noanswer must be equal; 0 for no overlap."""
    x, y = (F.filter(F.split(t, " "), lambda w: w != "") for t in (a, b))
    times = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, w: acc + F.least(times(x, w), times(y, w)))
    closed = ["yes", "no", "noanswer"]
    f1 = F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))
    return F.when((a.isin(closed) | b.isin(closed)) & (a != b), 0.0).otherwise(f1)


def last_answer(text: Column) -> Column:
    """The last <answer> of at least two (the first is the prompt's example)."""
    all_ = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(all_) >= 2, F.trim(F.element_at(all_, -1)))


def choice_letter(text: Column) -> Column:
    """The chosen letter: after 'answer is', in brackets, or the last lone capital A to D."""
    said = F.regexp_extract(text, r"(?i)answer\s*(?:is|:)\s*\(?([A-D])\)?(?![A-Za-z])", 1)
    box = F.regexp_extract(text, r"\(([A-D])\)", 1)
    lone = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])([A-D])(?![A-Za-z])"), F.lit(1))
    none = lambda c: F.nullif(c, F.lit(""))
    return F.upper(F.coalesce(none(said), none(box), F.when(F.size(lone) > 0, F.element_at(lone, -1))))


def _last_boxed(text: str) -> str | None:
    """Content of the last balanced \\boxed{...}."""
    at = text.rfind("\\boxed{")
    while at >= 0:
        depth = 0
        for i in range(at + 6, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                return text[at + 7 : i]
        at = text.rfind("\\boxed{", 0, at)
    return None


def last_boxed(text: Column) -> Column:
    return _typed(_last_boxed, T.StringType())(text)


def normal_number(text: Column) -> Column:
    """A final answer's text: no dollar signs, blanks, thousands commas, units or trailing zeros of a decimal."""
    bare = F.regexp_replace(text, r"[\s$]|\\[!,;]|\\text\{[^}]*\}|(?<=\d),(?=\d{3})", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\\d?frac\{([^{}]+)\}\{([^{}]+)\}$", "$1/$2"), r"(\.\d*?)0*$", "$1"), r"\.$", "")


def tags_in_order(text: Column, tags: list[str]) -> Column:
    """Whether the text's tags are opened and closed one after another in an order that the list allows to repeat."""
    names = "|".join(map(re.escape, tags))
    marks = F.regexp_extract_all(text, F.lit(rf"(</?(?:{names})>)"), F.lit(1))
    # The state is the open tag's name, '' outside, '!' after an error.
    step = lambda s, m: F.when(s == "!", "!").when(m.startswith("</"), F.when(F.concat(F.lit("</"), s, F.lit(">")) == m, "").otherwise("!")).when(s == "", F.regexp_replace(m, "[<>]", "")).otherwise("!")
    return F.aggregate(marks, F.lit(""), step) == ""


def parse_action(text: Column) -> tuple[Column, Column]:
    """(verb, argument) of a single ``verb[argument]``; NULL for none or for chained actions."""
    one = F.trim(text).rlike(r"^[a-z_]+\[[^\[\]]*\]$")
    return F.when(one, F.regexp_extract(F.trim(text), r"^([a-z_]+)\[", 1)), F.when(one, F.regexp_extract(F.trim(text), r"\[([^\[\]]*)\]$", 1))


def tool_calls(text: Column) -> Column:
    """Names of <tool_call name="..."> elements, in order."""
    return F.regexp_extract_all(text, F.lit(r'<tool_call name="([^"]+)">'), F.lit(1))


class _Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "head")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "head") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def _parsed(x: str) -> _Visible:
    p = _Visible()
    p.feed(x)
    p.close()
    return p


def visible_text(markup: Column) -> Column:
    """Visible text nodes joined by ' [SEP] '."""
    return _typed(lambda x: " [SEP] ".join(_parsed(x).out), T.StringType())(markup)


def links(markup: Column) -> Column:
    return _typed(lambda x: _parsed(x).links, T.ArrayType(T.StringType()))(markup)


def redacted(text: Column) -> Column:
    """Task, episode and product numbers replaced by marks."""
    t = F.regexp_replace(text, r"task-[0-9]+(__sample-[0-9]+)?", "<task>")
    t = F.regexp_replace(t, r"chunk-[0-9a-f]{12}", "<chunk>")
    return F.regexp_replace(t, r"A[0-9A-F]{7,10}", "<product>")


def safe_name(text: Column, longest: int = 120) -> Column:
    """Letters, digits, dot, dash and underscore only."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), 1, longest)


# Budgets ------------------------------------------------------------------------

#: Values of numeral characters (fixed values).
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000}


def numeral(text: str) -> float | None:
    """Value of an Arabic or Chinese numeral, with k, w, 千, 万 as factors."""
    text = text.strip().replace(",", "")
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([kKwW千万百]?)", text)
    if m:
        return float(m[1]) * {"": 1, "k": 1e3, "w": 1e4, "千": 1e3, "万": 1e4, "百": 100}[m[2].lower()]
    if text and all(c in _DIGITS for c in text):  # 三五 is read digit by digit
        return float("".join(str(_DIGITS[c]) for c in text))
    short = re.fullmatch(r"(.+)([百千万])([一二三四五六七八九两])", text)
    if short and (head := numeral(short[1])) is not None:  # 三千五 is 3500
        return (head + _DIGITS[short[3]] / 10) * _UNITS[short[2]] if short[2] not in short[1] else None
    total = part = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c]
        elif c == "万":
            total, part, digit = total + (part + digit or 1) * 10_000, 0, 0
        elif c in _UNITS:
            part, digit = part + (digit or 1) * _UNITS[c], 0
        else:
            return None
    return float(total + part + digit) if text else None


_N = r"(\d[\d,]*(?:\.\d+)?[kKwW千万百]?|[零一二三四五六七八九十百千万两〇]+)"
#: Rules in order; the first that matches decides. 'low' is a lower bound: no ceiling. 'about' allows the tolerance.
_RULES = [
    ("range", re.compile(rf"{_N}\s*(?:元|块|yuan)?\s*(?:-|~|—|至|到|to)\s*{_N}\s*(?:元|块|yuan)?", re.I)),
    ("low", re.compile(rf"(?:不低于|至少|at least|more than|over)\s*{_N}|{_N}\s*(?:元|块|yuan)?\s*(?:以上|起|or more)", re.I)),
    ("max", re.compile(rf"(?:不超过|不高于|低于|少于|最多|至多|控制在|under|below|at most|no more than|up to|within)\s*{_N}|{_N}\s*(?:元|块|yuan)?\s*(?:以内|以下|之内|内|or less)", re.I)),
    ("about", re.compile(rf"(?:大约|大概|约|around|about)\s*{_N}|{_N}\s*(?:元|块|yuan)?\s*(?:左右|上下)", re.I)),
    ("max", re.compile(rf"(?:预算|budget)(?:\s*(?:是|为|of|is|:|：))?\s*{_N}|{_N}\s*(?:元|块|yuan)", re.I)),
]


def _budget(text: str, tolerance: float) -> float | None:
    for kind, rule in _RULES:
        m = rule.search(text)
        if not m:
            continue
        if kind == "low":
            return None
        got = [x for x in map(numeral, filter(None, m.groups())) if x is not None]
        if got:
            return round(max(got) * (tolerance if kind == "about" else 1.0), 6)
    return None


def budget_ceiling(text: Column, tolerance: float = 1.1) -> Column:
    """The price ceiling that an instruction states, or NULL; a lower bound ends the search without one."""
    return _typed(lambda x: _budget(x, tolerance), T.DoubleType())(text)
