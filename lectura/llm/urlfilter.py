"""URL filtering by allow and block rules, then by a weighted vocabulary.

A url's host runs from behind the first `://` to the next `/`, `?`, `#` or the end, its path from there to `?`, `#`
or the end. The longest rule whose host is the url's host or a parent domain and whose path begins the url's path
decides. Urls without a rule are judged by an Aho-Corasick automaton over host and path. A term is hit where no letter or
digit stands right before it, nor right behind it or its plural's s; a stem, which no ordinary word holds, needs one such
boundary only. Strict terms and stems weigh `NEEDED`, soft ones less; the distinct terms hit block if they weigh `NEEDED`
together, that is by one strict term or several soft ones.

Defined results: a null url, or one without `://`, has empty host and path and no hits, so it is allowed; repeated
rows get equal verdicts; very long urls are scanned whole; input columns pass through, and where one has the name of
an output it is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from types import MappingProxyType

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The vocabulary: strict terms, stems, soft terms that weigh two, soft terms that weigh one.
STRICT_TERMS = (
    "adult", "bdsm", "bordell", "callgirl", "camgirl", "cialis", "erotic", "erotica", "erotik", "escort", "escorte", "fetish", "levitra", "milf", "nsfw", "nude", "phentermine", "prostituta", "puta", "sex", "sexcam", "sexe", "sexo", "sexy",
    "striptease", "warez", "xvideo", "xxx",
)
STRICT_STEMS = ("casino", "hentai", "porn", "viagra")
SUSPECT_TERMS = (
    "apuesta", "betting", "gambling", "jackpot", "keygen", "kinky", "naked", "payday", "pill", "poker", "rencontre", "roulette", "serialz", "slot", "spam", "sportwetten", "torrent", "wetten",
)
SOFT_TERMS = (
    "bet", "billig", "bonus", "cam", "cheap", "cita", "click", "coupon", "crack", "credito", "dating", "deal", "discount", "download", "farm", "free", "gewinn", "girl", "gratis", "gratuit", "hot", "kostenlos", "kredit", "loan", "oferta",
    "premio", "promo", "rabatt", "single", "webcam", "win",
)
NEEDED = 3
WEIGHTS = {**dict.fromkeys(STRICT_TERMS, NEEDED), **dict.fromkeys(SUSPECT_TERMS, 2), **dict.fromkeys(SOFT_TERMS, 1)}
STEMS = dict.fromkeys(STRICT_STEMS, NEEDED)


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host, "" if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, "" if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, null if none fits. Of equals the first named wins."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chain is None else chain


def _automaton(terms: Mapping[str, int], stems: Mapping[str, int], needed: int = NEEDED) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for of, is_stem in ((terms, False), (stems, True)):
        for term, weight in of.items():
            found.add_word(term, (term, is_stem, weight, weight >= needed))
    found.make_automaton()
    return found


def vocabulary_hits(place: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Distinct strict and soft terms hit in a lower-cased string, and what they weigh together."""
    seen = {}
    for end, (term, is_stem, weight, strict) in automaton.iter(place):
        before = end - len(term)
        opens = before < 0 or not place[before].isalnum()
        rest = place[end + 1 : end + 3]
        closes = not rest[:1].isalnum() or (rest[0] == "s" and not rest[1:].isalnum())
        if (opens or closes) if is_stem else (opens and closes):
            seen[term] = (strict, weight)
    n_strict = sum(strict for strict, _ in seen.values())
    return n_strict, len(seen) - n_strict, sum(weight for _, weight in seen.values())


def filter_urls(
    df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", terms: Mapping[str, int] = MappingProxyType(WEIGHTS), stems: Mapping[str, int] = MappingProxyType(STEMS), needed: int = NEEDED
) -> DataFrame:
    """Adds host, path, rule (null if none fits), n_strict, n_soft, weight and verdict ("allow" or "block")."""
    terms, stems = dict(terms), dict(stems)

    @F.pandas_udf("struct<n_strict:int,n_soft:int,weight:int>")
    def hits(places: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(terms, stems, needed)
        for series in places:
            yield pd.DataFrame([vocabulary_hits(p, automaton) for p in series], columns=["n_strict", "n_soft", "weight"])

    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = longest_rule(host, path, rules)
    packed = F.struct(ruled.alias("rule"), hits(F.lower(F.concat(host, path))).alias("hits"), host.alias("host"), path.alias("path"))
    name = unused(df, "judged")
    found = df.withColumn(name, packed)
    of = lambda field: F.col(f"{name}.{field}")
    weighed = F.when(of("hits.weight") >= needed, "block").otherwise("allow")
    return found.withColumns(
        {"host": of("host"), "path": of("path"), "rule": of("rule.rule"), "n_strict": of("hits.n_strict"), "n_soft": of("hits.n_soft"), "weight": of("hits.weight"), "verdict": F.coalesce(of("rule.verdict"), weighed)}
    ).drop(name)
