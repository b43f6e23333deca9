"""URL filters: logistic regression over hashed character n-grams of host and path.

A small table of labelled URLs trains the model; explicit rules for a host
(with its subdomains) and a path prefix come before it, the longest winning.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged by the model like any other (an empty feature set, so the
intercept decides); repeated rows are each judged; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow_text import mix

BUCKETS = 1 << 14
#: Score from which the model blocks: more likely than not to be of the blocked kinds.
THRESHOLD = 0.5
SIZES = (3, 4, 5)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, score double"
#: The labelled URLs that the model is trained from: 1 is to be blocked.
LABELLED = (
    ("https://www.casino-jackpot.example/slots/free-spins", 1),
    ("http://bestcasino.example/play/roulette-bonus", 1),
    ("https://poker-bonus.example/join/casino/deposit", 1),
    ("http://cheap-pills.example/buy/viagra-online", 1),
    ("http://pharma-discount.example/order/cialis", 1),
    ("https://hot-singles.example/xxx/cams/live", 1),
    ("http://adult-videos.example/porn/free", 1),
    ("https://free-porn.example/watch/xxx", 1),
    ("http://escort-dating.example/adult/girls", 1),
    ("https://login-verify-account.example/secure/update/password.php", 1),
    ("http://bank-verify.example/signin/confirm/account", 1),
    ("https://win-prize.example/claim/free-iphone", 1),
    ("http://track.example/click?aff=1", 1),
    ("https://ads.example/banner/click/redirect", 1),
    ("http://download-crack.example/keygen/warez", 1),
    ("https://torrent-free.example/download/crack/serial", 1),
    ("http://payday-loans.example/apply/instant-cash", 1),
    ("https://forex-signals.example/profit/guaranteed", 1),
    ("http://crypto-doubler.example/invest/bitcoin-profit", 1),
    ("https://weight-loss-miracle.example/buy/now", 1),
    ("https://betting-tips.example/bet/odds/bonus", 1),
    ("http://replica-watches.example/shop/rolex-cheap", 1),
    ("https://spam-links.example/seo/backlinks/buy", 1),
    ("http://proxy-unblock.example/warez/mirror", 1),
    ("https://www.university.example/physics/lecture-notes", 0),
    ("https://en.encyclopedia.example/wiki/History_of_science", 0),
    ("https://news.daily.example/2023/05/politics/election-results", 0),
    ("http://blog.gardener.example/en/how-to-grow-tomatoes", 0),
    ("https://docs.library.example/en/latest/tutorial.html", 0),
    ("https://museum.example/de/ausstellung/1204", 0),
    ("https://www.journal.example/fr/article/3381", 0),
    ("https://recipes.example/es/receta/4127", 0),
    ("http://m.weather.example/en/forecast/", 0),
    ("https://forum.linux.example/thread/8823?page=2", 0),
    ("https://city.example/en/council/minutes/2021.html", 0),
    ("https://www.hospital.example/patients/visiting-hours", 0),
    ("https://research.example/papers/graph-algorithms", 0),
    ("http://archive.example/texts/novel/chapter-3", 0),
    ("https://school.example/fr/classe/calendrier", 0),
    ("https://www.travel.example/de/reise/berlin", 0),
    ("https://music.example/en/review/1977", 0),
    ("https://history.example/en/5210.html", 0),
    ("http://www.nature.example/es/aves/2290", 0),
    ("https://math.example/questions/1822/prime-numbers", 0),
    ("https://books.example/en/90211#top", 0),
    ("https://blog.science.example/en/2210?utm_source=feed", 0),
    ("https://film.example/fr/critique/7781/", 0),
    ("https://m.sport.example/de/tabelle/33", 0),
    # Paths of the neutral kind under both kinds of hosts, or the path alone would decide.
    ("https://www.casino-royal.example/en/4410", 1),
    ("http://online-casino.example/de/7702.html", 1),
    ("http://m.betting-odds.example/fr/618?page=3", 1),
    ("https://bets-bonus.example/es/2205/", 1),
    ("https://ads-server.example/en/913?utm_source=mail", 1),
    ("http://m.click-track.example/de/5081#end", 1),
    ("http://www.pills-online.example/fr/3317.html", 1),
    ("https://cheap-meds.example/es/740", 1),
    ("http://blog.adult-tube.example/en/6124", 1),
    ("https://adult-cams.example/de/259/", 1),
    ("https://www.spam-seo.example/en/8406?page=4", 1),
    ("http://spam-mailer.example/fr/1573.html", 1),
    ("https://www.orchard.example/en/4418", 0),
    ("http://bridge-club.example/de/7713.html", 0),
    ("http://m.lighthouse.example/fr/627?page=3", 0),
    ("https://weather-station.example/es/2211/", 0),
    ("https://observatory.example/en/921?utm_source=mail", 0),
    ("http://m.theatre.example/de/5090#end", 0),
    ("http://www.northern-times.example/fr/3325.html", 0),
    ("https://botany.example/es/751", 0),
    ("http://blog.another-thing.example/en/6133", 0),
    ("https://mathematics.example/de/268/", 0),
    ("https://www.station.example/en/8415?page=4", 0),
    ("http://theory.example/fr/1582.html", 0),
)


def parts(url="url"):
    """(host, path) columns of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def buckets(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of ``^host`` and ``/path$``, told apart by a seed."""
    found = []
    for seed, text in ((1, f"^{host}^" if host else ""), (2, f"{path}$" if path else "")):
        data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(data) < n:
                continue
            code = np.full(len(data) - n + 1, seed * 16 + n, np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + data[k : len(data) - n + 1 + k]
            found.append(mix(code) % np.uint64(BUCKETS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        at = buckets(host, path)
        z = self.bias + self.weights[at].sum() / max(1.0, np.sqrt(len(at)))
        return float(1 / (1 + np.exp(-z)))


def split(url: str | None) -> tuple[str, str]:
    """``parts`` in plain Python."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    head = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[head:]
    path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:head]), path


def train(labelled=LABELLED, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Gradient descent on the log loss with weight decay, over a small table."""
    rows = [(buckets(*split(u)), y) for u, y in labelled]
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        grad, slope = decay * weights, 0.0
        for at, y in rows:
            root = max(1.0, np.sqrt(len(at)))
            error = 1 / (1 + np.exp(-(bias + weights[at].sum() / root))) - y
            grad[at] += error / root / len(rows) * 8
            slope += error / len(rows)
        weights, bias = weights - rate * grad, bias - rate * slope
    return UrlModel(weights, bias)


def rule_for(host, path, rules):
    """(action, name) of the longest rule that fits, or nulls; of rules of one length the later one wins."""
    chosen = F.lit(None).cast("struct<action:string,name:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("name"))).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: host, path, the rule that fits, the verdict and the model's score."""
    model = model or train()
    host, path = parts()
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    base = base.select("page_id", "url", "host", "path", F.col("fit.name").alias("rule"), F.col("fit.action").alias("verdict"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            verdict = [v or ("block" if s >= threshold else "allow") for v, s in zip(batch.column(5).to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=SCHEMA_NAMES)

    return base.mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
