"""URL filter rules indexed by their rarest literal token, in DataFrame functions alone.

Every rule is a regular expression with the literal tokens it can't match without. The tokens' frequencies over
all URLs are counted (only rule tokens are counted, so the counts are as many as those), each rule is filed under
its rarest token, and the filing table goes into the plan as a literal in blocks of bounded size. A URL's tokens
fetch its candidate rules from the slots of their hashes and only those expressions run. Nothing is shuffled but
the counts, so repeated URLs and hosts cost nothing extra.

Host rules (a host, its subdomains and a start of the path) win by length over patterns; a pattern that matches
blocks. Null URLs and URLs without `://` have an empty host and path, fit no rule and are allowed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: The host rules, longest wins.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Words and word pairs that a blocked site's address has as whole tokens.
SPAM = """casino poker roulette blackjack jackpot slots bingo betting sportsbook bookmaker gambling
free-bets casino-win win-big cheap-pills online-pharmacy buy-viagra viagra cialis levitra xanax tramadol
porn xxx hardcore escorts camgirls payday-loan quick-loans fast-cash get-rich earn-money work-from-home
weight-loss diet-pills replica-watches fake-watches crypto-doubler free-money free-iphone click-here
hot-singles adult-dating torrent warez keygen cracked serial-keys phishing malware""".split()
#: File types that hold no page.
FILES = "exe msi dmg apk zip rar 7z gz tar iso bin jpg jpeg png gif webp mp3 mp4 avi mkv mov wav pdf woff woff2 css js".split()
#: Parts of a path that serve machines or sessions.
PATHS = "wp-login cgi-bin wp-admin xmlrpc logout signin unsubscribe trackback pingback doubleclick adserver clicktrack".split()

TOKEN = "[a-z0-9]+"
RULE = "slots array<array<struct<token:string,name:string,kind:string,verdict:string,weight:int,pattern:string>>>"
#: Rules in one literal table.
BLOCK = 5_000


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path (host rules) or the lower-cased address, and its literal tokens."""

    name: str
    kind: str
    verdict: str
    weight: int
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    literal = lambda x: re.sub(r"([.+*?()\[\]{}^$|\\-])", r"\\\1", x)
    # a path may go on after the rule's, so its last token needn't be whole
    whole = re.findall(TOKEN, host.lower()) + re.findall(TOKEN, re.sub(r"[a-zA-Z0-9]+$", "", path).lower())
    return Rule(host + path, "host", verdict, len(host + path), f"^([^/]*\\.)?{literal(host)}{literal(path)}", tuple(whole))


def patterns() -> list[Rule]:
    """The rules by address: spam words anywhere, file types at the path's end, service paths."""
    made = [Rule(w, "pattern", "block", len(w), "(^|[^a-z0-9])" + w.replace("-", "[-_.]") + "($|[^a-z0-9])", tuple(w.split("-"))) for w in SPAM]
    made += [Rule(f".{w}", "pattern", "block", len(w), rf"^[^/?#]*/[^?#]*\.{w}($|[?#])", (w,)) for w in FILES]
    return made + [Rule(f"/{w}", "pattern", "block", len(w), rf"^[^/?#]*/([^?#]*[^a-z0-9?#])?{w}($|[^a-z0-9])", tuple(w.split("-"))) for w in PATHS]


def parsed(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows the scheme."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), lower_ascii(rest)


def _filed(rules: list[Rule], often: dict[str, int]) -> Column:
    """A literal table: rules in the slot of their rarest token's hash."""
    slots: list[list[dict]] = [[] for _ in range(2 * len(rules) + 1)]
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (often.get(t, 0), -len(t), t))
        entry = {"token": rarest, "name": rule.name, "kind": rule.kind, "verdict": rule.verdict, "weight": rule.weight, "pattern": rule.pattern}
        slots[_slot(rarest, len(slots))].append(entry)
    return F.from_json(F.lit(json.dumps({"slots": slots})), RULE)["slots"]


def _slot(token: str, slots: int) -> int:
    """The same as pmod(crc32(token), slots) in SQL."""
    import zlib

    return zlib.crc32(token.encode()) % slots


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule (the host rule that won, else null), verdict and the names of matching patterns."""
    rules = rules if rules is not None else [host_rule(*r) for r in HOST_RULES] + patterns()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"))
    host, path, rest = parsed(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), rest.alias("_rest"))
    rows = rows.withColumn("_tokens", F.array_distinct(F.regexp_extract_all("_rest", F.lit(TOKEN), F.lit(0))))
    wanted = sorted({t for r in rules for t in r.tokens})
    counted = rows.select(F.explode(F.array_intersect("_tokens", F.split(F.lit(" ".join(wanted)), " "))).alias("token")).groupBy("token").count()
    often = {r["token"]: r["count"] for r in counted.collect()}
    address = F.concat("host", "path")
    matched = []
    for at in range(0, len(rules), BLOCK):
        table = _filed(rules[at : at + BLOCK], often)
        fetched = F.flatten(F.transform("_tokens", lambda t: F.filter(F.get(table, F.pmod(F.crc32(t.cast("binary")), F.size(table)).cast("int")), lambda e: e["token"] == t)))
        matched.append(F.filter(fetched, lambda e: F.when(e["kind"] == "host", F.rlike(address, e["pattern"])).otherwise(F.rlike(F.col("_rest"), e["pattern"]))))
    rows = rows.withColumn("_matched", F.concat(*matched))
    best = F.array_max(F.transform(F.filter("_matched", lambda e: e["kind"] == "host"), lambda e: F.struct(e["weight"].alias("weight"), e["name"].alias("name"), e["verdict"].alias("verdict"))))
    names = F.array_sort(F.transform(F.filter("_matched", lambda e: e["kind"] == "pattern"), lambda e: e["name"]))
    rows = rows.select("page_id", "host", "path", best.alias("_best"), names.alias("patterns"))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.size("patterns") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_best.name").alias("rule"), verdict.alias("verdict"), "patterns")


def oracle() -> str:
    """The same in SQL: the host rules in order of length, then any pattern."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ordered = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = {quoted(h)} OR host LIKE {quoted('%.' + h)}) AND starts_with(path, {quoted(p)}))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN {quoted(h + p)}" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN {quoted(v)}" for v, h, p in ordered)
    spam = " OR ".join(f"regexp_matches(rest, {quoted(r.pattern)})" for r in patterns())
    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS raw FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(raw, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(raw, '^[^/?#]*([^?#]*)', 1) AS path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rest FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {spam} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
