"""Operator 3: URL filters, by rules and a logistic regression.

Host and path are cut from the URL with SQL functions, and rules (a few, given
as parameters) are matched there as well: a rule fits its host and all of its
subdomains if the path starts with the rule's; the longest wins.  For URLs
that no rule fits, a logistic regression on hashed character n-grams of host
and path decides.  It is fitted on the driver from a small labelled URL table
(at most ``TRAIN_ROWS`` rows, those with the smallest hashes) by Newton steps
in the dual, so the cost depends on the rows of that table alone; the weights
are a fixed number of buckets and travel with the function.

Defined results: a null URL, and one without ``://``, has an empty host and an
empty path, which the regression judges by its intercept; a path must contain
a rule's path literally (a URL without a slash after the host fits no rule
whose path is ``/``); null ids and repeated rows are judged like any other; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import random
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.llm._shared import UPPER

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
RIDGE = 0.01
TRAIN_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: What the hosts and paths of the labelled table are made of: words of what a
#: blocklist holds (gambling, adult, drugs, piracy, fraud, advertising), and
#: ordinary words of the web.
BLOCKED_WORDS = (
    "casino", "poker", "jackpot", "slots", "roulette", "betting", "bets", "gamble", "lottery", "bingo", "xxx", "porn", "nude", "escort", "sex", "camgirls", "hookup",
    "viagra", "cialis", "pills", "pharma", "steroids", "weightloss", "torrent", "warez", "crack", "keygen", "pirate", "leaked", "spam", "phish", "malware", "trojan",
    "scam", "fraud", "botnet", "clickbait", "popup", "adserver", "ads", "tracker", "track", "banner", "affiliate", "doubleclick", "cheap", "replica", "payday", "loans",
    "getrich", "forex", "win", "winner", "prize", "free", "giveaway", "farm", "cheats", "hack", "stresser",
)
ORDINARY_WORDS = (
    "docs", "wiki", "news", "library", "museum", "school", "university", "recipes", "science", "history", "journal", "guide", "help", "weather", "sports", "city", "health",
    "music", "garden", "travel", "photo", "forum", "archive", "research", "paper", "lecture", "course", "student", "teacher", "kitchen", "bakery", "hotel", "train", "bridge",
    "river", "mountain", "forest", "theatre", "cinema", "gallery", "poetry", "novel", "letters", "language", "grammar", "physics", "biology", "chemistry", "medicine",
    "hospital", "council", "parliament", "justice", "market", "harbour", "village", "museums", "studio", "design", "software", "manual", "support", "contact", "about",
)
SEED_HOSTS = 1600


def seed_urls(spark: SparkSession, hosts: int = SEED_HOSTS, seed: int = 11) -> DataFrame:
    """The small labelled table of the registered query: url, blocked (0 or 1),
    one URL for each of so many hosts; a third are blocked."""
    return spark.createDataFrame(labelled_urls(hosts, seed), "url string, blocked int")


def labelled_urls(hosts: int, seed: int) -> list[tuple[str, int]]:
    """URLs whose label hangs on words of the two lists alone: made-up names,
    prefixes, domains and paths are the same on both sides."""
    rng = random.Random(seed)
    made_up = lambda: "".join(rng.choice(("b c d f g h j k l m n p r s t v w z th sh ch st tr bl".split())) + rng.choice("a e i o u ea ou er on in an".split()) for _ in range(rng.randint(2, 4)))
    out: dict[str, tuple[str, int]] = {}
    while len(out) < hosts:
        y = int(rng.random() < 1 / 3)
        own = lambda: rng.choice(BLOCKED_WORDS if y else ORDINARY_WORDS)
        inside = not (y and rng.random() < 0.2)  # else the path alone tells
        some = own if inside else made_up
        name = rng.choice((lambda: some(), lambda: f"{some()}-{some()}", lambda: f"{some()}-{made_up()}", lambda: f"{made_up()}-{some()}", lambda: some() + made_up(), lambda: made_up() if not y else some() + some(), lambda: made_up() if not y else f"{some()}{rng.randint(1, 99)}"))()
        host = rng.choice(("", "", "www.", "m.", "blog.", "cdn.")) + name + rng.choice((".example.com", ".example.org", ".example.net", ".com", ".org", ".info"))
        number = rng.randint(1, 9999)
        plain = rng.choice((f"/{rng.choice(('en', 'de', 'fr', 'es', 'it'))}/{number}", f"/{number}.html", f"/{made_up()}/{number}/", f"/{made_up()}", "/"))
        path = plain if inside and rng.random() < 0.7 else f"/{own()}/{rng.choice((number, made_up(), own()))}"
        out.setdefault(host, (f"{rng.choice(('http', 'https'))}://{host}{path}{rng.choice(('', '', '?page=2', '#top'))}", y))
    return list(out.values())


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    there = F.instr(url, "://")
    rest = F.coalesce(F.when(there > 0, F.substr(url, there + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: F.Column, path: F.Column, rules: tuple[Rule, ...]) -> tuple[F.Column, F.Column]:
    """The text and the verdict of the longest rule that fits, or null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def buckets(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of host and path; the two never share a bucket
    on purpose, and repeated n-grams count once."""
    out = []
    for side, part in (b"h", host), (b"p", path):
        if part:
            x = np.frombuffer(b"\x02" + part.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint64)
            for n in GRAMS:
                if len(x) >= n:
                    h = np.full(len(x) - n + 1, zlib.crc32(side + bytes([n])), np.uint64)
                    for k in range(n):
                        h = (h ^ x[k : k + len(h)]) * np.uint64(0x100000001B3)
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    out.append(h >> np.uint64(48))
    return np.unique(np.concatenate(out)).astype(np.int64) % BUCKETS if out else np.zeros(0, np.int64)


def _norm(b: np.ndarray) -> float:
    return 1.0 / np.sqrt(len(b)) if len(b) else 0.0


class Model:
    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def probability(self, host: str, path: str) -> float:
        b = buckets(host, path)
        z = self.intercept + self.weights[b].sum() * _norm(b)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


@functools.lru_cache(maxsize=4)
def fit_rows(rows: tuple[tuple[str, str, int], ...], ridge: float = RIDGE, steps: int = 25) -> Model:
    """Ridge logistic regression of (host, path, blocked) by Newton steps on
    the kernel of the rows; the intercept is a constant feature.  The same rows
    are not fitted again."""
    if not rows:
        return Model(np.zeros(BUCKETS), 0.0)
    sets = [buckets(h, p) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    kernel = np.ones((len(rows), len(rows)))  # of the constant feature
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    feature = np.concatenate([*sets, np.zeros(0, np.int64)])
    norm = np.array([_norm(b) for b in sets])
    for low in range(0, BUCKETS, 4096):  # so that no table of all features is held
        at = (feature >= low) & (feature < low + 4096)
        x = np.zeros((len(rows), 4096), np.float32)
        x[owner[at], feature[at] - low] = 1.0
        kernel += (x @ x.T) * norm[:, None] * norm[None, :]
    a = np.zeros(len(rows))  # weights are features times a
    for _ in range(steps):
        z = kernel @ a
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        s = np.maximum(p * (1 - p), 1e-9)
        new = np.linalg.solve(s[:, None] * kernel + ridge * np.eye(len(rows)), s * z + y - p)
        done = np.abs(new - a).max() < 1e-10
        a = new
        if done:
            break
    weights = np.zeros(BUCKETS)
    np.add.at(weights, feature, (a * norm)[owner])
    return Model(weights, float(a.sum()))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """``labelled``: url, blocked (0 or 1); rows with a null are left out."""
    host, path = host_and_path(F.col("url"))
    some = labelled.filter("url is not null and blocked is not null").select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"), F.xxhash64("url").alias("h"))
    found = some.orderBy("h", "host", "path", "y").limit(rows).collect()
    return fit_rows(tuple((r.host, r.path, r.y) for r in found))


def judge(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and ``probability`` (of block, by the
    regression; null where a rule decides) of each row."""

    @F.pandas_udf("double")
    def probability(host: pd.Series, path: pd.Series, ruled: pd.Series) -> pd.Series:
        return pd.Series([None if r else model.probability(h, p) for h, p, r in zip(host, path, ruled)], dtype="float64")

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict})
    rows = rows.withColumn("probability", probability("host", "path", F.col("ruled").isNotNull()))
    learned = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("probability")).alias("probability"))


def pages_digest(pages: DataFrame) -> DataFrame:
    """The columns that ``op3_url_filter`` returns."""
    model = fit(seed_urls(pages.sparkSession))
    return judge(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")
