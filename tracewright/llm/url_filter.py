"""URL filtering: host and path rules first, then logistic regression on hashed character n-grams.

Everything that touches the judged table is a DataFrame expression. The model is fitted on the
driver from a small labelled table (``MAX_LABELLED`` rows at most, else an error).

Defined cases: a null url, or one without ``://``, has an empty host and path, matches no rule and is
judged by the model on the empty string (allow). Repeated rows are judged each; an empty table gives
an empty result; a column of the input that has the name of an added one is kept as ``<name>_given``. Time grows with a
url's length, whatever it is.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_apart, private

BUCKETS = 1024
MAX_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: verdict, host, path; the longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The labelled table is made of these words, alone and in pairs. They are general words: none is a host of the given pages table.
BAD = """casino poker roulette blackjack jackpot slots betting bets bookie gambling wager lottery sweepstake bingo viagra cialis
tramadol xanax pills pharma steroid dietpill slimming botox replica fakewatch counterfeit warez crack keygen serial torrent nulled
adult porn xxx escort webcam hookup sexchat nude erotic payday loan cash quickcash credit debt forex binary profit moneymaker getrich
prize winner giveaway freegift spam linkfarm backlink clickbait popup adserver adtrack tracker banner doubleclick affiliate malware
phishing spyware trojan hacked exploit scam hoax""".split()
GOOD = """library museum garden history science weather travel kitchen music school forum council university archive journal gazette
hospital theatre recipe mountain river station engine teacher bakery bridge castle village harbour island forest meadow farm orchard
market street church chapel temple college academy institute society club league team football tennis cricket swimming cycling hiking
sailing fishing camping cooking painting drawing sculpture pottery weaving knitting sewing fashion design studio gallery cinema film
radio television newspaper magazine book poetry novel story language grammar dictionary translation physics chemistry biology geology
astronomy planet ocean climate energy solar electric battery motor railway airport bicycle truck vehicle insurance lawyer court justice
police fire rescue health clinic dentist nurse doctor medicine nutrition fitness yoga family children parent baby wedding birthday
holiday hotel hostel restaurant coffee tea wine beer cheese bread butter apple lemon cherry potato onion pepper carpenter plumber
painter builder architect furniture window door kitchenware tool hardware software developer program database network server computer
laptop phone camera photo video audio piano guitar violin orchestra choir dance ballet festival concert ticket software-docs wiki
community charity volunteer government ministry parliament embassy region county district postal bank finance economics statistics
mathematics algebra geometry philosophy religion culture heritage tradition dog cat horse bird rabbit butterfly insect flower rose
tulip oak maple pine smith johnson miller brown wilson taylor anderson thompson martin garcia lopez schmidt weber fischer dubois moreau
rossi bianchi novak london paris berlin madrid rome vienna prague lisbon dublin oslo helsinki boston denver chicago toronto sydney
tokyo kyoto delhi cairo nairobi""".split()
PREFIXES = ["", "www.", "en.", "shop.", "news.", "my."]
DOMAINS = ["com", "org", "net", "info", "co.uk", "de", "fr", "es", "io", "eu", "biz", "example.com", "example.org", "example.net"]
PATHS = ["", "/", "/index.html", "/about", "/p/123", "/article/2020/05/a-title", "/category/items?page=2", "/view.php?id=77", "/en/page/9", "/fr/page-12", "/de/seite/4/", "/es/pagina/31", "/static/file.pdf"]


def _chosen(*of) -> int:
    """A number that follows from a text alone, so the table is the same on all machines."""
    return zlib.crc32("|".join(map(str, of)).encode())


def made_up(n: int) -> list[str]:
    """Names of letters drawn evenly, consonants and vowels in turn: a host whose name is no known word is not unwanted for that."""
    drawn = lambda i, k: "bcdfghjklmnprstvwz"[_chosen(i, k) % 18] + "aeiou"[_chosen(k, i) % 5]
    closed = lambda i: "bdfklmnprstxz"[_chosen(i, "end") % 13] if i % 2 else ""
    return ["".join(drawn(i, k) for k in range(2 + i % 3)) + closed(i) for i in range(n)]


def labelled_urls(held: bool = False) -> list[tuple[str, int]]:
    """The built-in labelled table: url, 1 for unwanted; ``held`` gives the hosts that are kept from training, a fifth of all names."""
    rows = []
    for label, words in ((1, BAD), (0, [*GOOD, *made_up(300)])):
        for word in words:
            for j in range(16 if label else 4):
                second = words[_chosen(word, j) % len(words)]
                name = (word, f"{word}-{second}", f"{second}{word}", f"{word}{j}")[j % 4]
                if (_chosen("part", name) % 5 == 0) == held:
                    host = PREFIXES[_chosen("prefix", word, j) % len(PREFIXES)] + name + "." + DOMAINS[_chosen("domain", word, j) % len(DOMAINS)]
                    rows.append((f"http://{host}{PATHS[_chosen('path', word, j) % len(PATHS)]}", label))
    return rows


def held_out_shares() -> tuple[float, float]:
    """Of the held-out table, the shares of unwanted and of wanted URLs that the model judges rightly (without the rules)."""
    w, b = default_model()
    right: dict[int, list[bool]] = {0: [], 1: []}
    for url, label in labelled_urls(held=True):
        ids = gram_ids(grams_text(*split_url(url)))
        right[label].append((sum(w[i] for i in ids) / max(1, len(ids)) ** 0.5 + b > 0) == bool(label))
    return sum(right[1]) / len(right[1]), sum(right[0]) / len(right[0])


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def grams_text(host: str, path: str) -> str:
    """What the n-grams are taken from: digits as 0, so page numbers carry nothing; other than printable ASCII as ?."""
    s = "".join("0" if c.isdigit() and c.isascii() else c if " " <= c <= "~" else "?" for c in host + path)
    return f"^{s}$"


def gram_ids(text: str) -> list[int]:
    return [(ord(text[i]) * 961 + ord(text[i + 1]) * 31 + ord(text[i + 2])) % BUCKETS for i in range(len(text) - 2)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as ``host_of`` and ``path_of`` give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return host.translate(str.maketrans(UPPER, LOWER)), rest[:end]


def train(rows: list[tuple[str | None, int]], rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent; features are n-gram counts over the square root of their number. Weights are rounded to 6 digits."""
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"a labelled table of at most {MAX_LABELLED} rows is expected")
    x, y = np.zeros((len(rows), BUCKETS)), np.array([label for _, label in rows], float)
    for i, (url, _) in enumerate(rows):
        ids = gram_ids(grams_text(*split_url(url)))
        np.add.at(x[i], ids, 1 / max(1, len(ids)) ** 0.5)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= rate * (x.T @ (p - y) / max(1, len(y)) + decay * w)
        b -= rate * float(np.mean(p - y)) if len(y) else 0.0
    return np.round(w, 6), round(b, 6)


@lru_cache(1)
def default_model() -> tuple[tuple[float, ...], float]:
    w, b = train(labelled_urls(), rounds=3000, rate=3.0, decay=1e-5)
    return tuple(w.tolist()), b


def _sum_of(codes: Column, table: Column) -> Column:
    """The weights of all trigrams of an array of character codes, added up in order."""
    bucket = lambda i: ((F.get(codes, i) * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2)) % BUCKETS).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(codes) - 3, F.lit(0))), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.try_element_at(table, bucket(i)), F.lit(0.0)))


def logit(host: Column, path: Column, weights, bias: float) -> Column:
    """The model's log odds. The weights are one folded array literal of ``BUCKETS`` doubles."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    text = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.concat(host, path), "[^ -~]", "?"), "[0-9]", "0"), F.lit("$"))
    n = F.length(text) - 2
    # the codes of all characters are one array, bound once; looking a character up in a string takes time by its place
    bound = F.transform(F.array(F.transform(F.split(text, ""), lambda c: F.ascii(c))), lambda codes: _sum_of(codes, table))
    total = F.get(bound, 0)
    return F.when(n > 0, total / F.sqrt(F.greatest(n, F.lit(1)))).otherwise(0.0) + F.lit(bias)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a short list becomes one CASE expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


ADDED = ["host", "path", "rule", "verdict", "score"]


def judge(pages: DataFrame, url: str = "url", rules=RULES, model=None) -> DataFrame:
    """Adds host, path, rule, verdict and score (the model's probability that the page is unwanted)."""
    weights, bias = model or default_model()
    own = private(pages.columns, "_url")
    out = given_apart(pages.withColumn(own, F.col(url).cast("string")), ADDED)
    out = out.withColumn("host", host_of(F.col(own))).withColumn("path", path_of(F.col(own))).drop(own)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    odds = logit(F.col("host"), F.col("path"), weights, bias)
    by_model = F.when(odds > 0, "block").otherwise("allow")
    return out.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, by_model)).withColumn("score", 1 / (1 + F.exp(-odds)))


def oracle() -> str:
    """The same in DuckDB SQL."""
    weights, bias = default_model()
    values = ",".join(f"{w:.6f}" for w in weights)
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, cases, strict=True)) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, '^' || regexp_replace(regexp_replace(host || path, '[^ -~]', '?', 'g'), '[0-9]', '0', 'g') || '$' AS t FROM b),
w AS (SELECT [{values}]::DOUBLE[] AS w),
d AS (SELECT c.*, coalesce(list_sum(list_transform(range(1, length(t) - 1), lambda i: w.w[(ascii(substr(t, i, 1)) * 961
  + ascii(substr(t, i + 1, 1)) * 31 + ascii(substr(t, i + 2, 1))) % {BUCKETS} + 1])), 0) / sqrt(greatest(length(t) - 2, 1)) + ({bias}) AS odds FROM c, w)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN odds > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM d"""
