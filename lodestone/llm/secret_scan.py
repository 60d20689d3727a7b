"""Secret scans: fixed patterns, and two character Markov models compared by their log-likelihood ratio. DataFrame functions only.

One model is learned from random strings, one from ordinary identifiers; both are first-order chains over the characters that
tokens have, ``len(ALPHABET)`` squared numbers each, counted from a labelled table by one aggregation. A token is a secret
if the random model is likelier by more than a threshold, which a held-out part of the labelled table sets. Scoring is an
expression over a text's tokens without a join or a shuffle. Places are code points: a text is split at the
matches of a pattern, and the lengths of the parts add up to where the matches are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import need

#: The characters of a token, and what a token is for the models.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Kinds in their order, pattern, the group whose length counts, and its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # runs are whole either way, so shorter ones needn't be listed and dropped
]
METHOD = "random"

#: Rows of each label in the default table, the share of the held-out ordinary samples that may be taken for secrets, and one in how many is held out.
SAMPLES, FALSE_ALARMS, HELD_OUT = 4000, 0.001, 5
#: No threshold is below this. Of tokens that the ordinary chain makes, a share of e^-threshold at most has so high a ratio (Markov's inequality).
LEAST_RATIO = math.log(1_000_000)
#: What each count has besides.
PRIOR = 0.5

#: Words that the ordinary samples are made of.
WORDS = """
access account action address agent amount archive array attribute backup balance batch block boolean bucket buffer button cache callback
catalog channel checksum client cluster column command commit config connection container content context controller count currency
customer database default delete deploy description device directory document domain element engine error event example export
factory feature field filter folder format function gateway global handler header helper history image import index input
instance integer interface internal invoice item kernel label language layout length library limit listener locale location logger
manager mapping memory message method metric migration model module monitor network notification number object offset option order
output package parameter parser partition password path payment performance permission pipeline plugin policy process product
profile project property protocol provider query queue reader record reference region register release report repository
request resource response result role router schedule schema search secret section security select sequence server service
session setting signature socket source status storage stream string structure subject summary support switch system table
target template thread timeout token transaction transform update upload user validation value variable vector version view
einheit verbindung rechnung entwicklung zeichenkette richtung gesellschaft wirtschaft möglichkeit geschichte leistung
sicherheit traitement fonction connexion utilisateur développement environnement caractère nombre fichier recherche réponse
conexión usuario desarrollo contraseña archivo función búsqueda respuesta configuración número ambiente servicio
""".split()


def labelled_samples(spark: SparkSession, rows: int = SAMPLES) -> DataFrame:
    """(token string, secret int, held_out boolean): ``rows`` random strings and as many ordinary identifiers. Another table with these
    columns can take its place.

    Random strings are cut from digests of the row number, written as hexadecimal digits, base 64, letters and digits, or capitals and
    digits. Ordinary ones are words joined in the ways of source code, paths and prose, and plain numbers; those held out
    are made of words that no other has.
    """
    n = F.col("id")
    pick = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), n), F.lit(many)).cast("int")
    digest = F.sha2(F.concat(F.lit("sample "), n.cast("string")).cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.translate(base64, "+/=", "")
    kinds = [digest, base64, plain, F.upper(plain), F.lower(plain), F.translate(base64, "+/", "-_")]
    length = 16 + pick("length", 25)
    random = F.substring(F.get(F.array(*kinds), pick("kind", len(kinds))), F.lit(1), length)

    held_out = pick("held", HELD_OUT) == 0
    ascii_words = [w for w in WORDS if w.isascii()]
    parts = [[w for i, w in enumerate(ascii_words) if (i % HELD_OUT == 0) == held] for held in (False, True)]
    either = F.array(*[F.array(*map(F.lit, part)) for part in parts])
    word = lambda salt: F.get(F.get(either, held_out.cast("int")), F.when(held_out, pick(salt, len(parts[1]))).otherwise(pick(salt, len(parts[0]))))
    words = F.slice(F.array(*[word(f"word{i}") for i in range(5)]), F.lit(1), 2 + pick("many", 4))
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100)))
    camel = F.array_join(capital, "")
    digits = F.conv(F.substring(digest, 1, 15), 16, 10)
    forms = [
        F.array_join(words, "_"), F.array_join(words, "-"), F.array_join(words, "/"), F.array_join(words, ""), camel, F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 200)), F.upper(F.array_join(words, "_")),
        F.upper(F.array_join(words, "")), F.concat(F.array_join(words, "_"), F.lit("_"), F.substring(digits, 1, 3)), F.concat(F.array_join(capital, "-"), F.substring(digits, 1, 2)), F.lpad(digits, 18, "4"),
        F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("-"), F.substring(digits, 5, 6)),
    ]
    ordinary = F.get(F.array(*forms), pick("form", len(forms)))
    numbers = spark.range(rows)
    of = lambda token, secret: numbers.select(token.alias("token"), F.lit(secret).alias("secret"), held_out.alias("held_out"))
    return of(random, 1).unionByName(of(ordinary, 0))


def _codes(token: Column) -> Column:
    """Of each character its place in the alphabet; of others the alphabet's length."""
    return F.transform(F.split(token, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(len(ALPHABET)))


def log_ratio(token: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios of the token's transitions; 0 below two characters."""
    size = len(ALPHABET) + 1
    weights = F.split(F.lit(",".join(f"{w:.9g}" for w in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("last"), F.when(s["last"] < 0, s["sum"]).otherwise(s["sum"] + F.get(weights, s["last"] * size + c)).alias("sum"))
    return F.aggregate(_codes(token), start, step, lambda s: s["sum"])


class Ratio:
    """The two chains' ratio table, learned from all but the held-out samples, and the threshold that these set."""

    def __init__(self, labelled: DataFrame, token_col: str = "token", label_col: str = "secret", held_col: str = "held_out", max_rows: int = 20_000, false_alarms: float = FALSE_ALARMS):
        """At most ``max_rows`` labelled rows are taken, those with the least hashes. Rows with a null are left out; without samples of a
        kind its chain is even, and without held-out ordinary ones the threshold is the least one."""
        known = need(labelled, token_col, label_col, held_col).select(F.col(token_col).alias("token"), F.col(label_col).alias("label"), F.col(held_col).alias("held")).dropna()
        known = known.orderBy(F.xxhash64("token", "label"), "token").limit(max_rows)
        learned = ~F.col("held")
        codes = _codes(F.col("token"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.struct(F.get("codes", i - 1).alias("a"), F.get("codes", i).alias("b")))
        counts = known.where(learned).select("label", codes.alias("codes")).where(F.size("codes") > 1).select("label", F.explode(pairs).alias("p")).groupBy("label", "p.a", "p.b").count()
        size = len(ALPHABET) + 1
        chains = {0: [PRIOR] * size**2, 1: [PRIOR] * size**2}
        for label, a, b, n in counts.collect():  # alphabet squared, twice, at most
            chains[label][a * size + b] += n
        totals = {label: [sum(c[a * size : (a + 1) * size]) for a in range(size)] for label, c in chains.items()}
        self.table = [math.log(chains[1][i] / totals[1][i // size]) - math.log(chains[0][i] / totals[0][i // size]) for i in range(size**2)]
        held = known.where(~learned).select("label", log_ratio(F.col("token"), self.table).alias("ratio"))
        cut = held.where("label = 0").agg(F.percentile("ratio", F.lit(1 - false_alarms)).alias("cut")).first().cut
        self.threshold = max(LEAST_RATIO, cut if cut is not None else LEAST_RATIO)
        self.held_out = held


def _within(values: Column, begin: Column) -> Column:
    """Running sums of a short array, from ``begin`` on."""
    start = F.struct(begin.alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")), lambda s: s["out"])


def running_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an array of bigint, by blocks, so that long arrays aren't copied for each value."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), _within(sums, F.lit(0).cast("bigint")))
    return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), _within))


def places(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, end, match) for the matches of a pattern, which are never empty. Code points, end exclusive."""
    sizes = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    parts = F.slice(F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint")), F.lit(1), F.size(matches))
    ends = running_sums(F.zip_with(parts, sizes, lambda a, b: a + b))
    at = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(F.size(matches) > 0, at).otherwise(none)


def _span(kind: str, order: int):
    return lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("order"), p["end"].alias("end"), F.lit(kind).alias("kind"))


def spans(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row; spans: array of (start, order, end, kind), by start, then by kind.

    The matches of each of ``KINDS``, leftmost and without overlap within a kind, that are long enough; and the tokens that the models take
    for random and that no such match overlaps. A null or empty text has none. Ids pass as they are, nulls and repeats
    included. Other columns are not read. An empty table gives an empty one.
    """
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("id", "text", *[F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(f"m_{kind}") for kind, pattern, _, _ in KINDS], F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("m_token"))
    found = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        at = places(text, pattern, F.col(f"m_{kind}"))
        if group:  # long enough by a group of its own
            parts = F.when(F.size(f"m_{kind}") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
            at = F.transform(F.filter(F.arrays_zip(at.alias("at"), parts.alias("part")), lambda z: F.length(z["part"]) >= least), lambda z: z["at"])
        else:
            at = F.filter(at, lambda p: F.length(p["match"]) >= least)
        found.append(F.transform(at, _span(kind, order)).alias(f"s_{kind}"))
    rows = rows.select("id", places(text, TOKEN, F.col("m_token")).alias("tokens"), *found)
    inside = "|".join(f"{pattern}" for kind, pattern, group, _ in KINDS if not group)  # such matches lie within one token
    clear = F.filter("tokens", lambda t: ~t["match"].rlike(inside) & (log_ratio(t["match"], ratio.table) > ratio.threshold))
    clear = F.filter(clear, lambda t: ~F.exists("s_assign", lambda a: (a["start"] < t["end"]) & (t["start"] < a["end"])))
    everything = F.concat(*[f"s_{kind}" for kind, *_ in KINDS], F.transform(clear, _span(METHOD, len(KINDS))))
    return rows.select("id", F.array_sort(everything).alias("spans"))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of base spans of each kind, the digest of the base spans, and all spans; see ``spans``."""
    rows = spans(docs, Ratio(labelled), id_col, text_col)
    base = F.filter("spans", lambda s: s["order"] < len(KINDS))
    of_kind = lambda order: F.filter("spans", lambda s: s["order"] == order)
    numbers = [F.size(of_kind(order)).cast("bigint").alias(f"n_{kind}") for order, (kind, *_) in enumerate(KINDS)]
    return rows.select(F.col("id").alias(id_col), *numbers, F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
