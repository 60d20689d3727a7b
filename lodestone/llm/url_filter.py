"""URL filters: host and path rules, and a logistic regression on hashed character n-grams. DataFrame functions only.

The classifier is learned from a small labelled URL table (``MAX_LABELLED`` rows at most). Gradient descent runs on the
dual weights, one for each labelled row, so all of training is one aggregate expression over the table's Gram
matrix; the n-gram weights are the labelled rows' n-grams summed with those weights, ``BUCKETS`` numbers at most,
and scoring is an expression over a URL's n-grams without a join or a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, need

BUCKETS = 1 << 13
MAX_LABELLED = 1000
#: Lengths of the n-grams.
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
STEPS, RATE, DECAY = 300, 0.2, 0.002
#: The score from which on a URL is blocked; the bias is such that this fits the held-out rows.
THRESHOLD = 0.55

#: Names of labelled sites, invented after the kinds of sites that lists of blocked and of reputable ones have.
BLOCKED_SITES = """
luckyspin-casino royal777slots vegasjackpots pokernights crypto-dice sportsbet-tips megaslots-bonus baccarat-live lottowinner win-prize-now
casino-freespins onlinebets-odds roulette-bonus cheapmeds24 pharmacy-rx-discount genericpills-store viagra-cialis-shop weightloss-gummies
hairgrowth-secret steroids-direct miracle-diet-pills xanax-no-prescription hotgirls-chat adult-dating-nearby freepornvideos milf-hookups
nude-webcams escort-directory xxx-clips sexstories-archive adult-toys-sex secure-paypal-login appleid-unlock bank-update-alert
support-call-virus wallet-airdrop-claim metamask-restore parcel-fee-payment refund-form-claim verify-badge-login free-keygen-crack
torrent-warez serials-crack nulled-themes movies-free-stream driver-updater-setup flashplayer-update pc-cleaner-free toolbar-addon
modapk-hack clicktracker-adserve popunder-ads banner-exchange affiliate-cash-offer push-ads-delivery buy-followers-cheap
seo-backlinks-cheap linkfarm-directory guestpost-spam article-spinner-spam replica-rolex fake-designer-bags cheap-jerseys-outlet
discount-raybans make-money-fast bitcoin-doubler forex-robot-profit payday-loans-instant get-rich-signals work-from-home-cash
spam-mailer-pro bulk-spam-lists bets-bonus-code free-credit-score-win track-ads-pixel pills-cheap-online casino-cash-win adult-cams-xxx
""".split()
ALLOWED_SITES = """
city-library harbour-times university-northfield museum-of-glass regional-weather openparser gardeners-notebook town-hall kitchen-table-recipes
railway-timetable science-weekly cycling-club letters-archive childrens-hospital woodworkers-forum encyclopedia parliament-records
hiking-trails mountain-bookshop chemistry-society opera-house observatory local-bakery versionhub school-district birdwatch
national-park theatre-royal kernel-mailing-list carrepair-manuals volunteer-fire-brigade language-podcast finance-ministry daily-courier
contemporary-gallery veterinary-clinic population-statistics chess-federation mountain-rescue music-school family-trees oceanography
slow-trains court-judgments energy-agency nursing-handbook knitting-patterns farmers-market cloud-status public-radio geology-survey
lecture-notes sailing-club food-bank poetry-magazine architects-guild waterworks philosophy-department zoo-animals ferry-times
dictionary-online post-office beekeeping publicdomain-books rowing-team swimming-pool cathedral-choir historical-society
botanic-garden planetarium electronics-repair parents-council primary-school bus-routes community-kitchen thermal-baths
""".split()
#: Fixed values that both kinds get in the same turns, so that names tell them apart.
_BEFORE, _AFTER = ("", "www.", "m.", "en.", "home."), (".com", ".net", ".org", ".info", ".co.uk", ".de", ".io")
_PATHS = ("", "/", "/index.html", "/about", "/2021/05/today", "/item?id=31", "/pages/contact.php", "/a/b/c", "/view/8812", "/start#top", "/search?q=all")
#: Rows of an allowed site for one of a blocked site: a name without evidence is rather allowed.
ALLOWED_WEIGHT = 2
#: Names that tell nothing are made of syllables, so many of them; one name in ``HELD_OUT`` is held out; of the held-out names to allow, at
#: most this share is blocked.
SYLLABLES, UNKNOWN, HELD_OUT, FALSE_BLOCKS = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"], 60, 5, 0.005


def _unknown(begin: int, many: int) -> list[str]:
    """Names of two to four syllables, by the digits of their numbers."""
    return ["".join(SYLLABLES[n * 31**k % len(SYLLABLES)] for k in range(2 + n % 3)) for n in range(begin, begin + many)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked int, held_out boolean): the labelled table. Another one with these columns can be given in its place."""
    url = lambda i, name: f"http://{_BEFORE[i % 5]}{name}{_AFTER[i % 7]}{_PATHS[i % 11]}"
    rows = [(url(i, name), label, i % HELD_OUT == 0) for names, label in ((BLOCKED_SITES, 1), (ALLOWED_SITES, 0), (_unknown(100, UNKNOWN), 0)) for i, name in enumerate(names)]
    rows += [(url(i, name), 0, True) for i, name in enumerate(_unknown(10_000, 4 * UNKNOWN))]  # not learned from, so they cost nothing
    rows = [row for row in rows for _ in range(1 if row[1] or row[2] else ALLOWED_WEIGHT)]
    values = ", ".join(f"('{url}', {label}, {str(held).lower()})" for url, label, held in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS labelled(url, blocked, held_out)")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, kind: str, length: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.transform(starts, lambda at: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, at, F.lit(length))), F.lit(BUCKETS)).cast("int"))


def gram_buckets(host: Column, path: Column) -> Column:
    """Array of the buckets of all n-grams of host and path, repeats included; the ends are marked."""
    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    parts = [_grams(host, f"host{n}", n) for n in HOST_GRAMS] + [_grams(path, f"path{n}", n) for n in PATH_GRAMS]
    return F.concat(*parts)


def trained_weights(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> tuple[list[float], float]:
    """(weight of each bucket, bias). Null labels are left out; repeated rows weigh more; all 0 without rows."""
    known = need(labelled, url_col, label_col).where(F.col(label_col).isNotNull())
    grams = gram_buckets(host_of(F.col(url_col)), path_of(F.col(url_col)))
    numbered = known.select((F.row_number().over(Window.orderBy(F.col(url_col), F.col(label_col))) - 1).alias("row"), F.col(label_col).cast("double").alias("y"), grams.alias("grams"))
    if (n := numbered.count()) > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; at most {MAX_LABELLED} are taken")
    if not n:
        return [0.0] * BUCKETS, 0.0
    scaled = numbered.select("row", F.explode("grams").alias("bucket"), (1 / F.sqrt(F.size("grams"))).alias("x")).groupBy("row", "bucket").agg(F.sum("x").alias("x"))
    a, b = scaled.select(F.col("row").alias("a"), "bucket", "x"), scaled.select(F.col("row").alias("b"), "bucket", F.col("x").alias("z"))
    products = a.join(b, "bucket").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    by_row = products.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "k"))).alias("k"))
    dense = by_row.select(F.col("a").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.element_at("k", j), F.lit(0.0)) + 1).alias("k"))
    rows = dense.join(numbered.select("row", "y"), "row").agg(F.array_sort(F.collect_list(F.struct("row", "k", "y"))).alias("rows"))

    def step(dual: Column, _: Column) -> Column:
        margins = F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.aggregate(F.zip_with(r["k"], dual, lambda k, d: k * d), F.lit(0.0), lambda s, v: s + v).alias("m")))
        return F.zip_with(dual, margins, lambda d, r: d * (1 - RATE * DECAY) - RATE * (1 / (1 + F.exp(-r["m"])) - r["y"]))

    dual = rows.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda _: F.lit(0.0)), step)).alias("row", "dual"))
    found = scaled.join(dual, "row").groupBy("bucket").agg(F.sum(F.col("x") * F.col("dual")).alias("w")).union(dual.agg(F.lit(-1), F.sum("dual")))
    weights, bias = [0.0] * BUCKETS, 0.0
    for bucket, w in found.collect():  # BUCKETS + 1 rows at most
        if bucket < 0:
            bias = w
        else:
            weights[bucket] = w
    return weights, bias


def block_score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """Probability that a URL is to be blocked."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    grams = gram_buckets(host, path)
    margin = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g)) / F.sqrt(F.size(grams)) + bias
    return 1 / (1 + F.exp(-margin))


#: The rules.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]], what: int) -> Column:
    """Of the longest rule that fits, its action (what = 0) or its text (1); null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # of equally long ones the last by text, then block
        at, slash, rest = rule[1].partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def held_out_bias(labelled: DataFrame, weights: list[float], bias: float, threshold: float = THRESHOLD, false_blocks: float = FALSE_BLOCKS) -> float:
    """The bias with which that share of the held-out rows to allow reaches the threshold.

    The trained one, if there are no such rows."""
    rows = labelled.where("held_out and blocked = 0").select(block_score(host_of(F.col("url")), path_of(F.col("url")), weights, bias).alias("score"))
    found = rows.select(F.log(F.col("score") / (1 - F.col("score"))).alias("margin")).agg(F.percentile("margin", F.lit(1 - false_blocks)).alias("cut")).first().cut
    return bias if found is None else bias - (found - math.log(threshold / (1 - threshold)) + 1e-6)


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row: the longest fitting rule's action, else the classifier's (block from ``threshold`` on).

    The classifier is learned from the labelled rows that aren't held out; those that are move its bias (``held_out_bias``). Without a
    column ``held_out``, all are learned from. A labelled table that is empty, or has one label only, gives every URL about the
    same score. A null url, or one without ``://``, has an empty host and path. Ids are passed on as they are, nulls and repeats
    included. Other columns are not read. An empty table gives an empty one.
    """
    rules = RULES if rules is None else rules
    parted = "held_out" in labelled.columns
    weights, bias = trained_weights(labelled.where("not held_out") if parted else labelled)
    bias = held_out_bias(labelled, weights, bias, threshold) if parted else bias
    split = need(pages, id_col, url_col).select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host, path = F.col("host"), F.col("path")
    scored = split.withColumn("score", block_score(host, path, weights, bias))
    verdict = F.coalesce(matching_rule(host, path, rules, 0), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", matching_rule(host, path, rules, 1).alias("rule"), verdict.alias("verdict"), "score")
