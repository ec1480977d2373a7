"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table (its rows are a parameter). Applying it is one projection
of built-in functions: n-grams are polynomials over code points modulo `buckets`, so that any SQL engine can say the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, beginning of the path); a rule holds for its host and all subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def training_urls() -> list[tuple[str, int]]:
    """A small labelled table, 1: block. Each of a few hosts and paths that are typical of either side, combined."""
    bad_hosts = ("free-casino", "hot-singles", "cheap-pills", "torrent-zone", "win-prize", "adult-cams", "click-bait", "m.tracker", "ads.popups")
    bad_paths = ("/win/bonus.html?ref=x", "/xxx/video-41.html?utm_source=ad", "/pills/buy-now?page=2&ref=mail", "/download/crack.exe?ref=x", "/bet/slots/777?utm_source=pop", "/popup/redirect?ref=click")
    good_hosts = ("www.university", "blog.library", "news.city", "docs.project", "www.museum", "science.journal", "health.agency", "weather.office", "www.school")
    good_paths = ("/en/1024", "/de/artikel/38.html", "/fr/histoire/12/", "/about/team", "/es/noticias/2044#top", "/research/papers/17.html")
    ends = (".com", ".net", ".org")
    out = []
    for hosts, paths, label in ((bad_hosts, bad_paths, 1), (good_hosts, good_paths, 0)):
        out += [(f"https://{h}{ends[(i + j) % 3]}{p}", label) for i, h in enumerate(hosts) for j, p in enumerate(paths)]
    return out


@dataclass(frozen=True)
class Params:
    rules: tuple[tuple[str, str, str], ...] = RULES
    urls: tuple[tuple[str, int], ...] = field(default_factory=lambda: tuple(training_urls()))
    sizes: tuple[int, ...] = (3, 4)
    buckets: int = 4096
    epochs: int = 60
    rate: float = 0.5
    penalty: float = 1e-3
    threshold: float = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, the same as the columns below."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else None
    if rest is None:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def buckets_of(host: str, path: str, p: Params) -> list[int]:
    """The bucket of each n-gram, with repeats: of `^host$`, then of the path and `$`, which have other seeds."""
    out = []
    for seed, text in ((7, f"^{host}$"), (1, f"{path}$")):
        codes = [ord(c) for c in text]
        for n in p.sizes:
            for i in range(len(codes) - n + 1):
                h = seed
                for c in codes[i : i + n]:
                    h = (h * 257 + c) % 2097143
                out.append(h % p.buckets)
    return out


def fit(p: Params) -> tuple[list[float], float]:
    """Weights and bias; plain gradient steps over the small table, one row after the other."""
    weights, bias = [0.0] * p.buckets, 0.0
    rows = [(buckets_of(*split_url(u), p), y) for u, y in p.urls]
    for _ in range(p.epochs):
        for found, y in rows:
            if found:
                z = bias + sum(weights[b] for b in found) / len(found) * 10
                step = p.rate * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
                bias -= 0.05 * step
                for b in found:
                    weights[b] -= step * 10 / len(found) + p.penalty * weights[b] / len(found)
    return [round(w, 6) for w in weights], round(bias, 6)


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    return F.translate(F.regexp_extract(rest, r"^[^?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), r"(?s)^[^?#]*", 0)


def filter_urls(pages: DataFrame, url: str = "url", p: Params | None = None) -> DataFrame:
    """pages with the added columns host, path, rule, score and verdict (those of these names are replaced).

    A rule fits its host and all subdomains if the path begins with the rule's; of those that fit the longest (host and
    path together) wins, of equally long ones the first. A null url or one without `://` has an empty host and path and
    gets the model's verdict on those. Repeated rows stay; an empty table gives an empty result.
    """
    p = p or Params()
    weights, bias = fit(p)
    base = pages.withColumn("__url", F.coalesce(F.col(url), F.lit(""))).drop("host", "path", "rule", "score", "verdict")
    base = base.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    host, path = F.col("host"), F.col("path")
    rules = sorted(enumerate(p.rules), key=lambda r: (-len(r[1][1] + r[1][2]), r[0]))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for _, (says, at, begins) in reversed(rules):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begins)
        rule, verdict = F.when(fits, F.lit(at + begins)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    table = F.array(*[F.lit(w) for w in weights])

    def grams(text: Column, seed: int, n: int) -> Column:
        codes = F.filter(F.split(text, ""), lambda c: c != "")
        count = F.greatest(F.size(codes) - (n - 1), F.lit(0))
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

        def bucket(i: Column) -> Column:
            h = F.lit(seed).cast("long")
            for k in range(n):
                h = (h * 257 + F.ascii(F.element_at(codes, i + k))) % 2097143
            return (h % p.buckets).cast("int")

        return F.transform(at, bucket)

    found = F.concat(*[grams(text, seed, n) for seed, text in ((7, F.concat(F.lit("^"), host, F.lit("$"))), (1, F.concat(path, F.lit("$")))) for n in p.sizes])
    mean = F.aggregate("__b", F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1)) / F.greatest(F.size("__b"), F.lit(1))
    score = F.round(1 / (1 + F.exp(-(F.lit(bias) + mean * 10))), 6)
    return (
        base.withColumns({"rule": rule, "__rule": verdict, "__b": found})
        .withColumn("score", score)
        .withColumn("verdict", F.coalesce("__rule", F.when(F.col("score") >= p.threshold, "block").otherwise("allow")))
        .drop("__url", "__rule", "__b")
    )


def oracle(p: Params | None = None) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict, score over pages."""
    p = p or Params()
    weights, bias = fit(p)
    fits = [(f"({'host'} = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{begins}')", says, at + begins) for says, at, begins in sorted(p.rules, key=lambda r: -len(r[1] + r[2]))]
    parts = []
    for seed, text in ((7, "'^' || host || '$'"), (1, "path || '$'")):
        for n in p.sizes:
            h = str(seed)
            for k in range(n):
                h = f"(({h} * 257 + unicode(substr(t, i + {k}, 1)::VARCHAR)) % 2097143)"
            parts.append(f"SELECT page_id, {h} % {p.buckets} AS b FROM (SELECT page_id, {text} AS t, unnest(range(1, greatest(length({text}) - {n - 1}, 0) + 1)) AS i FROM u)")
    return f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM s),
w AS (SELECT unnest(range(0, {p.buckets})) AS b, unnest([{', '.join(map(repr, weights))}]) AS w),
g AS ({' UNION ALL '.join(parts)}),
m AS (SELECT page_id, sum(w::DECIMAL(18, 6))::DOUBLE / count(*) AS m FROM g JOIN w USING (b) GROUP BY page_id),
d AS (SELECT u.page_id, host, path, round(1 / (1 + exp(-({bias} + coalesce(m, 0) * 10))), 6) AS score FROM u LEFT JOIN m ON u.page_id = m.page_id)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {c} THEN '{name}'" for c, _, name in fits)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{says}'" for c, says, _ in fits)} ELSE CASE WHEN score >= {p.threshold} THEN 'block' ELSE 'allow' END END AS verdict
FROM d"""
