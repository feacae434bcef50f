"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import map_slices

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Terms of which one is enough (the default vocabulary; ``vocabulary`` reads any other from a file).
STRICT = (
    "camgirl", "camgirls", "cialis", "escortservice", "escorts", "gangbang", "hentai", "keygen", "keygens", "onlinecasino", "onlinekasino",
    "porn", "porndude", "pornhub", "porno", "pornos", "pornstar", "pornstars", "redtube", "sexcam", "sexcams", "sexshop", "viagra", "warez",
    "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Terms of which SOFT_NEEDED distinct ones are, in the languages of the pages.
SOFT = (
    "adult", "apuestas", "betting", "bonus", "casino", "cheap", "citas", "crack", "cul", "dating", "desnuda", "desnudas", "erotic", "erotica",
    "erotik", "erotique", "escort", "fetish", "fick", "free", "gamble", "gambling", "gluecksspiel", "gratis", "gratuit", "hookup", "jackpot",
    "jeux", "kasino", "kredit", "loan", "loans", "milf", "naked", "nackt", "nude", "nudes", "nue", "nues", "payday", "pharmacy",
    "pills", "poker", "prestamo", "rencontre", "roulette", "sex", "sexe", "sexo", "sexy", "slots", "spielautomat", "torrent",
    "torrents", "tragaperras", "webcam", "wetten", "win",
)
SOFT_NEEDED = 2


def vocabulary(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """``strict`` and ``soft`` terms of a file with a line ``strict<TAB>term`` or ``soft<TAB>term`` each.

    Terms are lower-cased (A-Z); other lines, empty terms and repetitions are
    ignored.  The result goes to ``filter_urls`` as options; its size is that
    of a word list, which travels with the function.
    """
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for row in spark.read.text(path).toLocalIterator():
        kind, _, term = row[0].partition("\t")
        if kind.strip() in found and term.strip():
            found[kind.strip()].add(ascii_lower(term.strip()))
    return {k: tuple(sorted(v)) for k, v in found.items()}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [len(rest) if (n := rest.find(c)) < 0 else n for c in "/?#"]
    host, rest = rest[: min(ends)], rest[min(ends) :]
    path = rest[: min(len(rest) if (n := rest.find(c)) < 0 else n for c in "?#")]
    return ascii_lower(host), path


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class UrlFilter:
    """Rules and vocabulary, compiled once per worker."""

    def __init__(self, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED):
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.soft_needed = soft_needed
        words = {t: weight for weight, terms in ((1, soft), (self.soft_needed, strict)) for t in terms if t}
        #: None without terms: an empty automaton finds nothing, and the library refuses to search with it.
        self.terms = ahocorasick.Automaton() if words else None
        for t, weight in words.items():
            self.terms.add_word(t, (t, weight))
        if words:
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule (host and path together) that fits, with its verdict."""
        best, at = None, 0
        while host:
            for prefix, verdict in self.rules.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or len(host) - at + len(prefix) > len(best[0])):
                    best = host[at:] + prefix, verdict
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    def hits(self, url: str) -> dict[str, int]:
        """Distinct terms that stand as whole words, with their weights.

        A term's neighbours must not be ASCII letters; digits and any other
        characters are borders.
        """
        text, found = ascii_lower(url), {}
        if self.terms is None:
            return found
        letter = lambda i: 0 <= i < len(text) and "a" <= text[i] <= "z"
        for end, (term, weight) in self.terms.iter(text):
            if not letter(end + 1) and not letter(end - len(term)):
                found[term] = weight
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """``host, path, rule, verdict, weight``."""
        host, path = split_url(url)
        rule = self.rule(host, path)
        weight = sum(self.hits(url or "").values())
        verdict = rule[1] if rule else "block" if weight >= self.soft_needed else "allow"
        return host, path, rule[0] if rule else None, verdict, weight


def filter_urls(pages: DataFrame, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, weight`` for every row.

    Weight: a strict term counts as many as are needed, a soft one as one,
    each term once.  A null url has empty host and path, fits no rule and is
    allowed.  Without terms (an empty vocabulary) rules alone decide.  Repeated rows and null ids each give a row; no rows give none;
    other columns (the page itself above all) are never read.
    """

    def make():
        judge = UrlFilter(**options).judge

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict = {}
            rows = [seen[u] if u in seen else seen.setdefault(u, judge(u)) for u in b.column("url").to_pylist()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page_id", "host", "path", "rule", "verdict", "weight"])

        return work

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return map_slices(pages, "url", make, "page_id long, host string, path string, rule string, verdict string, weight int")


def op6_query(pages: DataFrame) -> DataFrame:
    """The verdict on every url of ``pages``; cases are those of ``filter_urls``."""
    return filter_urls(pages).drop("weight")
