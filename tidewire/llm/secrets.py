"""Secrets in whole texts, with DataFrame operations only: three patterns, and two character Markov models.

The models give each transition between two characters a probability: one is trained from random strings, one from
ordinary identifiers. A long run of key-like characters is a secret if the log of the likelihood ratio, averaged over
its transitions, is above a threshold, or if a long stretch of it says so by a sum that is far above what the
threshold would give. Both models are counted from a table of labelled samples; what reaches the driver is one count
for each pair of characters. What a pattern has found is blanked before runs are looked for, so a key beside it is judged too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, text_or_empty

#: The patterns in the order of the contract, and what a match must have at least: the group and its length.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: The models' own spans, and the runs they judge.
KIND = "markov"
LEAST = 20
RUN = rf"[A-Za-z0-9+/=_-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Mean log-likelihood ratio of a transition above which a run counts as random.
THRESHOLD = 0.35
#: By how much the best stretch of at least ``LEAST`` characters must exceed the threshold in sum, if the whole run stays below it.
SURE = 12.0

#: Ordinary words of program text, for samples of identifiers.
WORDS = "account address array async backup balance batch block buffer build cache callback catalog channel check client code column commit config connect context control convert count create current data date default delete detail device document domain driver element enable encode entry error event example execute factory field file filter folder format function global group handle header helper history image import index initial input insert instance internal item iterator language layer length level library limit line list loader local location manager message method model module name network node number object offset option order output package page parameter parent parse partition password path pattern payload permission pipeline policy position prefix private process product profile project property protocol provider public query queue random range reader record reference region register relation remote render replace report request reset resource response result return route sample schedule schema scope search section secret security select sequence server service session setting shared signature simple single source start state static status storage stream string structure table target task template test text thread time timeout title token total transaction transform type unique update upload user utility validate value variable version view virtual visible window worker wrapper write"


def default_samples(spark: SparkSession, n: int = 4000, ordinary: DataFrame | None = None) -> DataFrame:
    """Labelled samples (sample, random): ``n`` random strings of usual alphabets, and ``n`` identifiers joined from words or rulers of one character.

    ``ordinary`` may add words of the corpus's own kind (column ``word``); they are joined to long words as well.
    """
    part = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256)
    as64 = F.base64(F.unhex(F.concat(part(1), part(2))))
    random = spark.range(n).select(
        F.when(F.col("id") % 5 == 0, part(1))
        .when(F.col("id") % 5 == 1, F.upper(F.substring(F.regexp_replace(as64, "[^A-Za-z0-9]", ""), 1, 40)))
        .when(F.col("id") % 5 == 2, F.regexp_replace(as64, "[^A-Za-z0-9]", ""))
        .when(F.col("id") % 5 == 3, F.translate(as64, "+/", "-_"))
        .otherwise(as64)
        .alias("sample"),
        F.lit(True).alias("random"),
    )
    words = F.split(F.lit(WORDS), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    four = [pick(k) for k in range(4)]
    joined = spark.range(n).select(
        F.when(F.col("id") % 7 == 0, F.concat_ws("_", *four))
        .when(F.col("id") % 7 == 1, F.concat(four[0], *[F.initcap(x) for x in four[1:]]))
        .when(F.col("id") % 7 == 2, F.concat_ws("/", *four))
        .when(F.col("id") % 7 == 3, F.concat_ws("-", *four[:3], F.lit(2024) + F.col("id") % 9))
        .when(F.col("id") % 7 == 4, F.upper(F.concat_ws("_", *four)))
        .when(F.col("id") % 7 == 5, F.repeat(F.substring(F.lit(ALPHABET), ((F.col("id") / 7) % len(ALPHABET) + 1).cast("int"), F.lit(1)), 12))
        .otherwise(F.concat(*four))
        .alias("sample"),
        F.lit(False).alias("random"),
    )
    out = random.unionByName(joined)
    if ordinary is not None:
        out = out.unionByName(ordinary.select(F.concat("word", F.lit("_"), "word").alias("sample"), F.lit(False).alias("random")))
    return out


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random against ordinary) by first character x second character, from labelled samples.

    Characters outside the alphabet teach nothing, nor do null samples or labels.
    """
    chars = F.split(F.col("sample"), "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.concat(chars[i - 1], chars[i]))
    counted = samples.where(F.length("sample") > 1).where(F.col("random").isNotNull()).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET)
    place = {c: k for k, c in enumerate(ALPHABET)}
    seen = {True: [smooth] * (n * n), False: [smooth] * (n * n)}
    for row in counted:
        if len(row.pair) == 2 and row.pair[0] in place and row.pair[1] in place:
            seen[row.random][place[row.pair[0]] * n + place[row.pair[1]]] += row["count"]
    out = []
    for a in range(n):
        totals = {k: sum(v[a * n : a * n + n]) for k, v in seen.items()}
        out += [math.log(seen[True][a * n + b] / totals[True]) - math.log(seen[False][a * n + b] / totals[False]) for b in range(n)]
    return out


_SPANS = "array<struct<start:int,end:int,order:int,kind:string,match:string>>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once; inside a lambda an outer expression would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def _pieces(text: Column, pattern: str) -> Column:
    """The matches m of a pattern, each with the piece p of the text before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("p"), m.alias("m")))


def _enough(match: Column, pattern: str, group: int, least: int) -> Column:
    return (F.length(F.regexp_extract(match, pattern, group)) if group else F.length(match)) >= least


def _found(text: Column, pattern: str, kind: int, name: str, group: int, least: int) -> Column:
    """All matches as structs (start, end, order, kind, match), in code points; those with too short a group are dropped.

    Spark has no function for the places of matches. What lies between them does the same: match k starts after the
    first k + 1 pieces of the split text and the first k matches. Adding to an array copies it, so n matches are
    gathered in about sqrt(n) blocks of as many, and a text with very many costs little more than their number.
    """
    empty = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        span = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(kind).alias("order"), F.lit(name).alias("kind"), x["m"].alias("match"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.when(_enough(x["m"], pattern, group, least), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def block(z: Column, width: Column, acc: Column, first: Column) -> Column:
        own = F.aggregate(F.slice(z, first, width), F.struct(acc["at"].alias("at"), empty.alias("spans")), step)
        return _let(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["spans"], r["spans"]).alias("spans")))

    def gathered(z: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(z))).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.size(z), width), F.struct(F.lit(0).alias("at"), empty.alias("spans")), lambda acc, first: block(z, width, acc, first), lambda acc: acc["spans"])

    return F.when(text.rlike(pattern), _let(_pieces(text, pattern), gathered)).otherwise(empty)


def _blanked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with its matches replaced by as many spaces; those with too short a group stay."""
    last = F.element_at(F.split(text, pattern, -1), -1)
    kept = lambda x: F.when(_enough(x["m"], pattern, group, least), F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"])
    parts = F.transform(_pieces(text, pattern), lambda x: F.concat(x["p"], kept(x)))
    return F.when(text.rlike(pattern), F.concat(F.array_join(parts, ""), last)).otherwise(text)


def ratio(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    return _scored(run, table)["sum"] / F.greatest(F.length(run) - 1, F.lit(1))


def _scored(run: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """The sum of a run's log-likelihood ratios, and its stretch (from, upto: characters) that exceeds the threshold by the most in sum."""
    n = len(ALPHABET)
    place = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(F.lit(0).alias("k"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("here"), F.lit(0).alias("begin"), F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(0).alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        worth = F.when((acc["last"] < 0) | (x < 0), F.lit(0.0)).otherwise(F.get(F.array(*map(F.lit, table)), acc["last"] * n + x))
        return _let(worth, lambda w: _let(acc["here"] + w - F.when(acc["k"] > 0, F.lit(threshold)).otherwise(F.lit(0.0)), lambda h: F.struct(
            (acc["k"] + 1).alias("k"),
            x.alias("last"),
            (acc["sum"] + w).alias("sum"),
            F.greatest(h, F.lit(0.0)).alias("here"),
            F.when(h > 0, acc["begin"]).otherwise(acc["k"]).alias("begin"),  # a stretch begins with the character before its first transition
            F.greatest(h, acc["best"]).alias("best"),
            F.when(h > acc["best"], acc["begin"]).otherwise(acc["from"]).alias("from"),
            F.when(h > acc["best"], acc["k"] + 1).otherwise(acc["upto"]).alias("upto"),
        )))

    return F.aggregate(place, zero, step)


def _judged(runs: Column, table: list[float], threshold: float) -> Column:
    """The runs that are random as a whole, and the best stretches of others that are sure to be."""

    def judge(r: Column) -> Column:
        part = lambda s: F.struct((r["start"] + s["from"]).alias("start"), (r["start"] + s["upto"]).alias("end"), r["order"].alias("order"), r["kind"].alias("kind"), F.substring(r["match"], s["from"] + 1, s["upto"] - s["from"]).alias("match"))
        whole = lambda s: s["sum"] > threshold * F.greatest(F.length(r["match"]) - 1, F.lit(1))
        return _let(_scored(r["match"], table, threshold), lambda s: F.when(whole(s), r).when((s["best"] >= SURE) & (s["upto"] - s["from"] >= LEAST), part(s)))

    return F.filter(F.transform(runs, judge), lambda r: r.isNotNull())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(df: DataFrame, table: list[float], text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """Adds the spans of secrets (array of start, end, kind, match) and the digests of the contract under free names.

    A null text is empty and has no spans. Spans are ordered by start, then kind as listed. What the models judge
    random overlaps no span of a pattern that they see blanked. Rows depend on their own text alone, so ties and
    repeated rows need no care, and the longest text costs about as much as its parts; empty tables stay empty; other
    columns pass through, whatever their names.
    """
    names = {}
    for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"):
        names[k] = free_name(df, k)
    plain, base, runs, both = (free_name(df, x) for x in ("_t", "_base", "_runs", "_both"))
    out = df.withColumn(plain, text_or_empty(text))
    # Maximal runs of hex digits that are long enough are all runs less the short ones.
    kinds = [(PATTERNS[name][0] if name != "hex" else r"[0-9a-f]{24,}", *PATTERNS[name][1:]) for name in PATTERNS]
    found = [_found(col(plain), p, k, name, group, least) for k, (name, (p, group, least)) in enumerate(zip(PATTERNS, kinds, strict=True))]
    in_order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["order"] - b["order"])).cast("int")
    out = out.select(*[col(c) for c in df.columns], col(plain), F.array_sort(F.concat(*found), in_order).alias(base))
    blank = lambda kind: lambda t: _blanked(t, *kind)
    rest = col(plain)
    for kind in kinds:
        rest = _let(rest, blank(kind))
    search = lambda t: _found(t, RUN, len(PATTERNS), KIND, 0, LEAST)
    seen = F.when(F.size(col(base)) > 0, _let(rest, search)).otherwise(search(col(plain)))
    out = out.select(*[col(c) for c in df.columns], col(base), seen.alias(runs))
    out = out.withColumn(both, F.array_sort(F.concat(col(base), F.when(F.size(col(runs)) > 0, _judged(col(runs), table, threshold)).otherwise(col(runs))), in_order))
    count = lambda k: F.size(F.filter(col(base), lambda s: s["order"] == k)).cast("long")
    done = out.select(
        *[col(c) for c in df.columns],
        *[count(k).alias(names[f"n_{name}"]) for k, name in enumerate(PATTERNS)],
        F.sha2(_joined(col(base)), 256).alias(names["base_sha256"]),
        _joined(col(both)).alias(names["spans"]),
        F.transform(col(both), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"))).alias(names["secrets"]),
    )
    return done, names
