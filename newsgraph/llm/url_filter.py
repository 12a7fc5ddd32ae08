"""URL filtering: host and path rules, then a weighted vocabulary.

The vocabulary is searched with one Aho-Corasick pass over each URL, whatever
the number of terms. A term counts only between boundaries: the characters
beside it are not ASCII letters or digits. One strict term rejects; soft terms
reject when the weights of the distinct ones that occur reach the limit, which
takes two at least.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

# The shipped vocabulary. Strict terms reject alone.
STRICT_TERMS = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirls", "camsex", "sexcam", "escorts", "milf", "gangbang",
    "bukkake", "upskirt", "warez", "keygen", "crackz", "serialz", "onlinecasino", "casinobonus", "freespins", "viagra",
    "cialis", "levitra", "tramadol", "paydayloans",
)
# Soft terms by weight; terms of several kinds must come together to reach SOFT_LIMIT.
SOFT_GRADES = {
    3: (
        "casino", "gambling", "betting", "escort", "nude", "erotic", "fetish", "sexy", "sex", "webcam", "torrent", "jackpot",
        "payday", "pharmacy", "pills", "pirate", "crack", "roulette", "blackjack", "striptease", "slot",
    ),
    2: (
        "adult", "bet", "poker", "lottery", "dating", "hookup", "singles", "babes", "lingerie", "loan", "debt", "bingo",
        "wager", "tipster", "sportsbook", "steroid", "weed", "vape", "botox", "slimming", "replica", "hack", "cheat", "proxy",
        "forex", "bitcoin", "airdrop",
    ),
    1: (
        "free", "hot", "win", "bonus", "cheap", "deal", "discount", "coupon", "promo", "offer", "sale", "buy", "cash", "credit",
        "click", "download", "stream", "live", "chat", "cam", "girl", "teen", "spin", "prize", "gift", "vip", "unlimited",
        "instant", "guaranteed", "miracle", "diet", "keto", "detox", "rich", "profit", "earn", "invest", "crypto", "token",
        "wallet",
    ),
}
# Distinct soft terms of this weight together reject; no term has so much.
SOFT_LIMIT = 4


def _graded(grades: dict[int, Sequence[str]]) -> dict[str, int]:
    """Weights of terms and of their plurals, which count as terms of their own."""
    plain = {term: weight for weight, terms in grades.items() for term in terms}
    plurals = {f"{term}s": weight for term, weight in plain.items() if not term.endswith("s")}
    return {t: w for t, w in {**plurals, **plain}.items() if t not in STRICT_TERMS}


SOFT_TERMS = _graded(SOFT_GRADES)
# What a term may not stand beside, after A-Z are lower-cased; other letters than these are boundaries.
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The rules that the query applies.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Number of the longest rule that fits, or null; the earlier of equally long ones."""
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))
    found = None
    for k in order:
        rule = rules[k]
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(k)) if found is None else found.when(fits, F.lit(k))
    return F.lit(None).cast("int") if found is None else found


def _bounded_hits(automaton, url: str) -> set[str]:
    hits = set()
    for last, term in automaton.iter(url):
        first = last - len(term) + 1
        before, after = url[first - 1 : first] if first else "", url[last + 1 : last + 2]
        if before not in _INSIDE and after not in _INSIDE:
            hits.add(term)
    return hits


def score_urls(df: DataFrame, strict: Sequence[str], soft: dict[str, int]) -> DataFrame:
    """``page_id, url, n_strict, soft_weight, terms`` of the rows ``page_id, url``.

    Counts are of distinct terms. A null or empty URL has none.
    """
    weights = dict(soft)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in {*strict, *weights}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        strong = set(strict)
        fold = str.maketrans(UPPER, LOWER)
        for batch in batches:
            found = [_bounded_hits(automaton, (u or "").translate(fold)) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([len(x & strong) for x in found], pa.int64()),
                    pa.array([sum(weights[t] for t in x - strong) for x in found], pa.int64()),
                    pa.array([" ".join(sorted(x)) for x in found], pa.string()),
                ],
                names=["page_id", "url", "n_strict", "soft_weight", "terms"],
            )

    kind = dict(df.dtypes)["page_id"]
    rows = df.select("page_id", "url")
    if not strict and not soft:
        return rows.select("*", F.lit(0).cast("long").alias("n_strict"), F.lit(0).cast("long").alias("soft_weight"), F.lit("").alias("terms"))
    return rows.mapInArrow(score, f"page_id {kind}, url string, n_strict long, soft_weight long, terms string")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: dict[str, int] = SOFT_TERMS,  # noqa: B006
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """A verdict for every row: that of the longest rule, else of the vocabulary.

    ``page_id, url, host, path, rule, verdict, n_strict, soft_weight, terms``.
    A null URL, or one without ``://``, has an empty host and path, so no rule
    fits; a null one is allowed. Repeated rows give repeated rows, other columns
    are not read, an empty table gives an empty one.
    """
    scored = score_urls(pages, strict, soft)
    located = scored.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = located.select("*", matched_rule(F.col("host"), F.col("path"), rules).alias("number"))
    name = F.lit(None).cast("string")
    verdict = F.when((F.col("n_strict") > 0) | (F.col("soft_weight") >= soft_limit), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    for k, rule in enumerate(rules):
        name = F.when(F.col("number") == k, F.lit(rule.name)).otherwise(name)
        verdict = F.when(F.col("number") == k, F.lit(rule.verdict)).otherwise(verdict)
    return ruled.select(
        "page_id", "url", "host", "path", name.alias("rule"), verdict.alias("verdict"), "n_strict", "soft_weight", "terms"
    )
