"""URL filter whose rules are indexed by their rarest literal token.

A host rule fits its host and all subdomains when the path starts with the
rule's path; the longest rule wins.  Where none fits, pattern rules decide (any
that matches blocks), else the url is allowed.  Every rule is filed under the
literal token that the fewest urls of the table hold.  The tokens of a url fetch
the candidate rules, and only those run their regular expression.

Rules are taken in blocks of bounded size, of which a task unpacks one at a time.
Up to PASS_RULES rules go in one narrow pass over the urls; a longer list takes
more passes and gives the same result without shuffling a page.

Nulls: a null url and one without "://" have an empty host and path and no
rule.  Repeated rows are judged one by one.  An empty table gives an empty
result.  Other columns are kept; columns named like a result are replaced.
"""

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusq.llm.arrow import extend
from corpusq.plans.shipping import Held

TOKEN = r"[0-9a-z]+"
#: Rules that a task has unpacked at once, and rules (packed) of one pass.
BLOCK_RULES, PASS_RULES = 50_000, 400_000


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """Blocks a url whose host and path match; ``literals`` are tokens every match holds whole."""
    pattern: str
    literals: tuple


# The rules of the contract.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

#: Words of which the method's own rules are made: a subject and a lure, in either order, as a piece of a host or path.
SUBJECTS = (
    "poker", "slots", "bingo", "lottery", "roulette", "blackjack", "betting", "pharmacy", "steroids", "diet", "loans", "payday", "mortgage",
    "crypto", "forex", "replica", "handbags", "dating", "escort", "webcam", "torrent", "warez", "keygen", "serials", "ringtones",
    "sweepstakes", "giveaway", "followers", "backlinks", "traffic")
LURES = (
    "free", "best", "cheap", "online", "buy", "win", "bonus", "deal", "deals", "offer", "offers", "discount", "instant", "fast", "easy", "top",
    "hot", "live", "vip", "promo", "sale", "shop", "club", "zone", "world", "land", "hub", "central", "direct", "now", "today", "24h", "pro",
    "max", "mega", "super", "extra", "gold", "lucky", "secret")


def word_rule(*words: str) -> PatternRule:
    """Blocks a url that holds the words, joined by hyphens, as a whole piece between dots and hyphens."""
    return PatternRule(rf"(?:^|[.-]){'-'.join(words)}(?:[.-])", words)


def pattern_rules(subjects=SUBJECTS, lures=LURES) -> tuple[PatternRule, ...]:
    """The rule table of the method: words that block alone, pairs that block together, and every subject with every lure."""
    alone = [("casino",), ("pills",), ("adult",), ("free", "bets"), ("ads", "track"), ("spam", "farm")]
    pairs = [pair for s in subjects for l in lures for pair in ((s, l), (l, s))]
    return tuple(word_rule(*words) for words in [*alone, *pairs])


#: Rules of the method for urls that no host rule fits.
PATTERN_RULES = pattern_rules()

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Compiled(NamedTuple):
    rank: int        # longer host rules rank higher, patterns are 0
    name: str | None
    verdict: str
    pattern: str
    literals: tuple


def _compile(rule) -> Compiled:
    if isinstance(rule, PatternRule):
        return Compiled(0, None, "block", rule.pattern, rule.literals)
    host = re.findall(TOKEN, rule.host)
    # the last piece of a path that does not end in a delimiter may go on in the url
    path = [m.group() for m in re.finditer(TOKEN, rule.path.lower()) if m.end() < len(rule.path)]
    rest = re.escape(rule.path) if rule.path else "(?:/|$)"
    return Compiled(len(rule.host) + len(rule.path), rule.host + rule.path, rule.verdict,
                    rf"^(?:[^/]*\.)?{re.escape(rule.host)}{rest}", tuple(dict.fromkeys(host + path)))


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, and from there up to ? # or end."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_frequency(parts: DataFrame, tokens: list[str]) -> dict:
    """Urls per token over the whole table; one row per rule token comes back."""
    listed = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    held = F.array_distinct(F.expr(f"regexp_extract_all(lower(concat(host, path)), '{TOKEN}', 0)"))
    counts = (parts.select(F.explode(held).alias("token")).join(F.broadcast(listed), "token").groupBy("token").count())
    return {r["token"]: r["count"] for r in counts.collect()}


class Index:
    """Candidate rules by rarest token, compiled when first met."""

    def __init__(self, rules: list[Compiled], frequency: dict):
        self.by_token, self.always = {}, []
        for rule in rules:
            if rule.literals:
                self.by_token.setdefault(min(rule.literals, key=lambda t: (frequency.get(t, 0), t)), []).append(rule)
            else:
                self.always.append(rule)
        self.find = None

    def best(self, host: str, path: str, best):
        """The (rank, name, verdict) that wins, or ``best`` if nothing beats it; equal ranks go to block, then by name."""
        if self.find is None:
            self.find, self.match = re.compile(TOKEN, re.ASCII).findall, {}
        whole = host + path
        for token in {None, *self.find(whole.lower())}:
            for rule in self.always if token is None else self.by_token.get(token, ()):
                made = self.match.get(rule.pattern)
                if made is None:
                    made = self.match[rule.pattern] = re.compile(rule.pattern).search
                if made(whole):
                    found = (rule.rank, rule.verdict == "block", rule.name or "")
                    if best is None or found > best:
                        best = found
        return best


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES, block_rules: int = BLOCK_RULES) -> DataFrame:
    """Pages with host, path, rule (null where a pattern or nothing decided) and verdict."""
    host, path = url_parts()
    parts = pages.drop("host", "path", "rule", "verdict", "_best").withColumn("host", host).withColumn("path", path)
    rules = sorted({_compile(r) for r in (*host_rules, *patterns)}, key=lambda r: (r.rank, r.name or "", r.pattern))
    best = "_best struct<rank: int, block: boolean, name: string>"
    kind = pa.struct([("rank", pa.int32()), ("block", pa.bool_()), ("name", pa.string())])
    out = parts.withColumn("_best", F.lit(None).cast("struct<rank: int, block: boolean, name: string>"))
    tokens = sorted({t for r in rules for t in r.literals})
    frequency = token_frequency(parts, tokens) if tokens else {}
    for low in range(0, len(rules), PASS_RULES):
        some = rules[low:low + PASS_RULES]
        packed = Held(pages.sparkSession, [cloudpickle.dumps(Index(some[at:at + block_rules], frequency)) for at in range(0, len(some), block_rules)])
        out = out.withColumnRenamed("_best", "_had")

        def factory(packed=packed):
            packs = packed.get()
            only = cloudpickle.loads(packs[0]) if len(packs) == 1 else None

            def compute(batch):
                hosts, paths, had = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "path", "_had"))
                found = [(b["rank"], b["block"], b["name"]) if b else None for b in had]
                for pack in packs:
                    index = only or cloudpickle.loads(pack)
                    found = [index.best(h, p, b) for h, p, b in zip(hosts, paths, found)]
                return [pa.array([dict(zip(("rank", "block", "name"), f)) if f else None for f in found], kind)]
            return compute
        out = extend(out, best, factory).drop("_had")
    return (out.withColumn("rule", F.when(F.col("_best.rank") > 0, F.col("_best.name")))
            .withColumn("verdict", F.when(F.col("_best.block"), "block").otherwise("allow")).drop("_best"))
